"""Chat formatting in Spark expressions: sorted turn structs, adjacent turns of a role merged by an array fold.

The template, with \\n for a line feed:

    <s>[INST] role\\n text ([SEP] text)* [/INST]      a block of any other role
    <s>[OUT] text ([SEP] text)* </s>                  a block of the assistant, whose texts bear the loss

Control strings inside texts and roles are escaped by a backslash after their first character, and backslashes are
doubled, so the formatted text can be read back without loss. As a line feed ends a role, one inside a role is written
as a backslash and an n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning to the template or to common chat models. Each begins with < or [.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SEP]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>")
_REST = "|".join("".join("\\" + c if c in "[]/|<>" else c for c in x[1:]) for x in CONTROL)
OPEN, CLOSE, ANSWER, END, SEP = "<s>[INST] ", " [/INST]", "<s>[OUT] ", " </s>", "[SEP]"
ASSISTANT = "assistant"


def escape(x: F.Column) -> F.Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?=(?:{_REST}))", r"$1\\")


def unescape(x: F.Column) -> F.Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def escape_role(x: F.Column) -> F.Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: F.Column) -> F.Column:
    """A backslash and an n stands for a line feed unless the backslash is itself the second of a pair.

    No control string has an n after its first character, so an escape of one cannot be taken for it.
    """
    return unescape(F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, n_turns, blocks and formatted.

    blocks are structs (role, texts, loss) of merged adjacent turns in order of turn, then role, then text; formatted
    is the whole in the template. Null texts and roles count as empty; a null conversation is one of its own; repeated
    rows are turns of their own. Extra columns are left out. A conversation is gathered in one row, as its text is one
    value; none is cut.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    # Places where the role changes, then one slice for each: linear in the turns, unlike a fold that grows arrays.
    n = F.size("said")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("said", i)["role"] != F.element_at("said", F.greatest(i - 1, F.lit(1)))["role"]))
    rows = rows.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, n), F.array(n + 1)))
    block = lambda a, z: F.struct(
        F.element_at("said", a)["role"].alias("role"), F.transform(F.slice("said", a, z - a), lambda t: t["text"]).alias("texts"), (F.element_at("said", a)["role"] == ASSISTANT).alias("loss")
    )
    rows = rows.select("conv_id", n.cast("long").alias("n_turns"), F.zip_with("starts", "ends", block).alias("blocks"))
    joined = lambda b: F.array_join(F.transform(b["texts"], escape), SEP)
    written = F.transform(
        "blocks", lambda b: F.when(b["loss"], F.concat(F.lit(ANSWER), joined(b), F.lit(END))).otherwise(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n"), joined(b), F.lit(CLOSE)))
    )
    return rows.withColumn("formatted", F.array_join(written, ""))


def read_back(formatted: F.Column) -> F.Column:
    """Turns (role, text) of a formatted conversation, in order: array of structs, from the formatted text alone."""
    pieces = F.filter(F.split(formatted, "<s>"), lambda p: p != "")

    def turns(p: F.Column) -> F.Column:
        loss = F.startswith(p, F.lit("[OUT] "))
        body = F.when(loss, F.substring(p, F.lit(len("[OUT] ") + 1), F.length(p) - len("[OUT] ") - len(END))).otherwise(F.substring(p, F.lit(len("[INST] ") + 1), F.length(p) - len("[INST] ") - len(CLOSE)))
        cut = F.instr(body, "\n")
        role = F.when(loss, F.lit(ASSISTANT)).otherwise(unescape_role(F.substring(body, F.lit(1), cut - 1)))
        texts = F.when(loss, body).otherwise(F.substring(body, cut + 1, F.length(body)))
        return F.transform(F.split(texts, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(pieces, turns))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from formatted."""
    chats = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
