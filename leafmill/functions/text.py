"""Text functions as Spark expressions: lengths, trims, tokens, normal forms, hashes, times, colours, units."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import fold_items

#: White space that trimming removes besides ASCII's: no-break space, byte-order mark and the Unicode spaces.
_WS = r"[\s ﻿  -     　]"


def utf16_len(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def tokens_utf16(s: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_len(s) / F.lit(4.0)).cast("long")


def tokens(s: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(s) / F.lit(4.0)).cast("long")


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_WS}+|{_WS}+$", "")


def collapse(s: Column) -> Column:
    return trim_all(F.regexp_replace(s, f"{_WS}+", " "))


def loose_space(s: Column) -> Column:
    """Whether collapse changes s."""
    return s.rlike(f"^{_WS}|{_WS}$|{_WS}{{2}}|(?! ){_WS}")


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII letter and marks, and these letters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def fold(s: Column) -> Column:
    """Lower case without accents, Latin letters; combining marks are dropped."""
    return F.regexp_replace(F.translate(F.lower(s), _FROM, _TO), r"\p{M}", "")


def terms(s: Column) -> Column:
    """Search terms: folded text split at everything but a-z and 0-9."""
    return F.filter(F.split(fold(s), "[^a-z0-9]+"), lambda t: t != "")


def match_form(s: Column) -> Column:
    """For containment tests: lower case without any white space."""
    return F.regexp_replace(F.lower(s), f"{_WS}+", "")


def content_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 12)


def asset_hash(b: Column) -> Column:
    return F.substring(F.sha1(b), 1, 16)


def title_form(s: Column) -> Column:
    """Letters, digits and single spaces, lower case."""
    return collapse(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\s]+", " "))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def drop_leaders(s: Column) -> Column:
    """Dot leaders between a title and its page number become one space."""
    return F.regexp_replace(s, r"\s*(?:\.\s?){4,}\s*", " ")


def clock(sec: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.round(sec).cast("long")
    m, h = F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.floor(s / 3600).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    low = F.concat(two(m), F.lit(":"), two(F.pmod(s, F.lit(60))))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), low)).otherwise(low)


def caption_stamp(sec: Column) -> Column:
    ms = F.round(sec * 1000).cast("long")
    part = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(F.pmod(ms, F.lit(3600000)) / 60000), 2), F.lit(":"), part(F.floor(F.pmod(ms, F.lit(60000)) / 1000), 2), F.lit("."), part(F.pmod(ms, F.lit(1000)), 3))


def seconds(stamp: Column) -> Column:
    """[h:]mm:ss with comma or dot decimals to seconds; null where it is none."""
    p = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)\s*$"
    g = lambda i: F.regexp_extract(stamp, p, i)
    value = F.coalesce(F.nullif(g(1), F.lit("")).try_cast("double"), F.lit(0.0)) * 3600 + g(2).try_cast("double") * 60 + F.replace(g(3), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(stamp.rlike(p), value)


def pdf_date(v: Column) -> Column:
    """D:YYYYMMDDHHmmSS with an offset to ISO 8601 in UTC."""
    p = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Z+-])(\d{2})?'?(\d{2})?'?)?"
    g = lambda i, d: F.coalesce(F.nullif(F.regexp_extract(v, p, i), F.lit("")), F.lit(d))
    at = F.try_to_timestamp(F.concat_ws("-", g(1, ""), g(2, "01"), g(3, "01"), g(4, "00"), g(5, "00"), g(6, "00")), F.lit("yyyy-MM-dd-HH-mm-ss"))
    sign = F.when(g(7, "Z") == "+", -1).when(g(7, "Z") == "-", 1).otherwise(0)
    shift = sign * (g(8, "00").cast("int") * 60 + g(9, "00").cast("int"))
    return F.when(v.rlike(p), F.date_format(F.timestamp_add("MINUTE", shift, at), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda x: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x).cast("int"))))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def to_px(value: Column, unit: Column, dpi: float = 96.0) -> Column:
    return value * F.when(unit == "in", dpi).when(unit == "pt", dpi / 72).when(unit == "px", 1.0).otherwise(dpi / 25.4)


def fill_template(text: Column, **variables: Column) -> Column:
    """Each {{name}} replaced by its variable."""
    for name, value in variables.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), value.cast("string"))
    return text


def page_of_link(target: Column) -> Column:
    """0-based page of an internal link #page-N; null for others."""
    return F.nullif(F.regexp_extract(target, r"^#page-(\d+)$", 1), F.lit("")).cast("int") - 1


#: Media types by extension (fixed values).
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif", "bmp": "image/bmp",
    "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
    "mp3": "audio/mpeg", "wav": "audio/wav", "json": "application/json", "pdf": "application/pdf",
}


def mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), ext), F.lit("application/octet-stream"))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n.cast("double") - df + 0.5) / (df.cast("double") + 0.5))


def affine(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two affine matrices [a b c d e f]."""
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: s != "")


#: What a number in a table may end with (fixed values).
UNITS = ("ms", "s", "k", "m", "b", "M", "K", "B", "x", "×")


def is_numeric_cell(s: Column) -> Column:
    """Digits with decimals and one of UNITS, signs of currency, per cent, brackets, commas and a sign before them aside; dashes alone stand for a number too."""
    bare = F.regexp_replace(F.regexp_replace(s, _WS[:-1] + "$€£¥(),%]", ""), "^[+\\-−–]", "")
    return trim_all(s).rlike("^[—–\\-]+$") | bare.rlike(f"^\\d+(\\.\\d+)?({'|'.join(UNITS)})?$")


def percent_decode(s: Column) -> Column:
    """Each % and two hexadecimal digits as the byte they name; all else stays, + too. Bytes that are no UTF-8 become U+FFFD."""
    parts = F.regexp_extract_all(s, F.lit("((?s)%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))
    codes = F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.make_valid_utf8(F.unhex(F.array_join(codes, "")).cast("string"))


def data_url(s: Column) -> Column:
    """(mime, ext, content) of a base64 data URL; null where s is none, content null where its digits are broken."""
    form = r"^data:([^;]+);base64,(.*)$"
    mime = F.regexp_extract(s, form, 1)
    ext = F.regexp_replace(F.coalesce(F.get(F.split(mime, "/"), F.lit(1)), F.lit("")), "^(.*?)jpeg", "$1jpg")
    parts = F.struct(mime.alias("mime"), F.when(ext == "", "bin").otherwise(ext).alias("ext"), F.try_to_binary(F.regexp_extract(s, form, 2), F.lit("base64")).alias("content"))
    return F.when(s.rlike(form), parts)


#: Symbol fonts' private-use characters and what they show (fixed values); all others of U+E000 to U+F8FF are bullets.
GLYPHS = {
    0xF0B7: "•", 0xF0A7: "▪", 0xF0A8: "◻", 0xF0B2: "■", 0xF0A0: "◦", 0xF0B0: "◦", 0xF076: "❖", 0xF0D8: "➢",
    0xF0FC: "✓", 0xF0FE: "☑", 0xF0A3: "☐", 0xF0F0: "⇨", 0xF0E0: "→", 0xF0AE: "→", 0xF0AD: "←", 0xF0B6: "¶", 0xF02D: "−", 0xF0BE: "―",
    0xF0D7: "•", 0xF0A4: "◆", 0xF0F6: "✖", 0xF0FB: "✗", 0xF0E8: "⇒", 0xF0D0: "—",
}


def symbol_glyphs(s: Column) -> Column:
    """Private-use characters of symbol fonts as ordinary ones."""
    return F.regexp_replace(F.translate(s, "".join(map(chr, GLYPHS)), "".join(GLYPHS.values())), "[\uE000-\uF8FF]", "•")


#: Families by what a font's name holds, without spaces, hyphens and underscores; the first that fits (fixed values).
FAMILIES = [
    ("calibri|carlito", "Carlito, Calibri, sans-serif"),
    ("cambria", "Caladea, Cambria, serif"),
    ("georgia", "Gelasio, Georgia, serif"),
    ("courier|mono|consolas|menlo|sourcecode|firacode", "Cousine, 'Courier New', JetBrains Mono, monospace"),
    ("times|roman|garamond|baskerville|bookantiqua|palatino|minion", "Tinos, 'Times New Roman', serif"),
    ("plexsans", "'IBM Plex Sans', Arimo, sans-serif"),
    ("plexserif", "'IBM Plex Serif', Tinos, serif"),
    ("arial|helvetica|liberationsans|arimo|segoe|verdana|tahoma|roboto|inter|noto|opensans|lato|aptos|sans", "Arimo, Arial, Helvetica, sans-serif"),
    ("serif", "Tinos, 'Times New Roman', serif"),
]


def font_face(name: Column, serif: Column | None = None, monospace: Column | None = None, bold: Column | None = None, italic: Column | None = None) -> Column:
    """(family, bold, italic) of a font by its name and the flags of its file; the flags decide where the name says nothing."""
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s_-]+", "")
    flag = lambda f: F.coalesce(F.lit(False) if f is None else f, F.lit(False))
    family = F.when(n.rlike(FAMILIES[0][0]), FAMILIES[0][1])
    for pattern, face in FAMILIES[1:]:
        family = family.when(n.rlike(pattern), face)
    family = family.when(flag(monospace), "Cousine, 'Courier New', monospace").when(flag(serif), FAMILIES[4][1]).otherwise(FAMILIES[7][1])
    return F.struct(family.alias("family"), (flag(bold) | n.rlike("bold|black|heavy")).alias("bold"), (flag(italic) | n.rlike("italic|oblique")).alias("italic"))


def wrap(s: Column, most: int) -> Column:
    """Lines of at most `most` characters: broken at white space, longer words cut; line feeds stay, blank lines are empty."""

    def step(a: Column, w: Column) -> tuple[Column, Column]:
        pieces = F.regexp_extract_all(w, F.lit(f"((?s).{{1,{most}}})"), F.lit(1))
        fits = (a["line"] != "") & (F.length(a["line"]) + 1 + F.length(w) <= most)
        none = F.array().cast("array<string>")
        done = F.concat(F.when(a["line"] != "", F.array(a["line"])).otherwise(none), F.slice(pieces, 1, F.size(pieces) - 1))
        return F.struct(F.when(fits, F.concat_ws(" ", a["line"], w)).otherwise(F.element_at(pieces, -1)).alias("line")), F.when(fits, none).otherwise(done)

    def lines(line: Column) -> Column:
        folded = fold_items(F.filter(F.split(line, f"{_WS}+"), lambda w: w != ""), F.struct(F.lit("").alias("line")), "array<string>", step)
        return F.get(F.transform(F.array(folded), lambda r: F.array_append(F.flatten(r["items"]), r["state"]["line"])), F.lit(0))

    return F.flatten(F.transform(F.split(s, "\n"), lines))


_MASK = (1 << 32) - 1


def _times32(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32, in steps that fit 64 bits."""
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(_MASK)


def draw(seed: Column, i: Column) -> Column:
    """Number i (from 0) of the seeded stream mulberry32, in [0, 1). Its state grows by a constant, so any number of the
    stream is had by itself, on any row."""
    up = lambda x, n: F.shiftrightunsigned(x, n)
    state = (seed.cast("long").bitwiseAND(_MASK) + _times32((i.cast("long") + 1).bitwiseAND(_MASK), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(_MASK)
    x = _times32(state.bitwiseXOR(up(state, 15)), state.bitwiseOR(F.lit(1).cast("long")))
    x = x.bitwiseXOR((x + _times32(x.bitwiseXOR(up(x, 7)), x.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(_MASK))
    return x.bitwiseXOR(up(x, 14)) / F.lit(float(1 << 32))


def draw_between(seed: Column, i: Column, low: int, high: int) -> Column:
    return (F.floor(draw(seed, i) * (high - low + 1)) + low).cast("long")


def finite(v: Column, fallback: float) -> Column:
    """v, or fallback where it is null, no number or infinite."""
    d = v.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), fallback).otherwise(d)
