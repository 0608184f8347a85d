"""Sinks: chunk lines and arrays, the index block inside a document, vectors, folder manifests, bundles."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_lines(chunks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    chunks.write.mode("overwrite").json(path)


def chunk_array(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_seq") -> DataFrame:
    """(key, json): each document's chunks as one JSON array in order."""
    fields = [c for c in chunks.columns if c not in (key, order)]
    x = F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*fields)).alias("j"))))
    return chunks.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(x, lambda r: r["j"]), ","), F.lit("]")).alias("json"))


def inline_index(docs: DataFrame, chunks: DataFrame, chunker: str, key: str = "doc_id", value: str = "value") -> DataFrame:
    """docs with an index block {chunker, chunks} put last into the document's JSON text; an older one is replaced."""
    arrays = chunk_array(chunks, key)

    def run(batches):
        for pdf in batches:
            out = []
            for text, arr in zip(pdf[value], pdf["json"]):
                tree = json.loads(text)
                tree.pop("index", None)
                tree["index"] = {"chunker": chunker, "chunks": json.loads(arr) if arr else []}
                out.append(json.dumps(tree, ensure_ascii=False))
            yield pd.DataFrame({key: pdf[key], value: out})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, value).join(arrays, key, "left").mapInPandas(run, f"`{key}` {kind}, `{value}` string")


def vectors(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("model").parquet(path)


def folder_manifest(chunks: DataFrame, coverage: DataFrame, file: str = "file") -> DataFrame:
    """(file, chunks, tokens, media, covered): what a folder's index holds, for each file."""
    return chunks.groupBy(file).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")).join(coverage, file, "left")


def bundle_bytes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bundle): zip bundles of rows (key, name, content); entries in name order and without times, so equal
    content gives equal bytes."""

    def run(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: pdf[key].iloc[:1], "bundle": [out.getvalue()]})

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, bundle binary")
