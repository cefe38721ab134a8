"""python -m tessera.cli process-parquet | search"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .functions.embed import HashingEmbedder, generate
from .operators import etl
from .operators.store import VectorTable
from .plans.search import search
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("process-parquet", help="clean, truncate, embed and store the texts of a Parquet table")
    a.add_argument("path")
    a.add_argument("--store", help="collection folder")
    a.add_argument("--text-column", default="full_text")
    a.add_argument("--id-column", default="tweet_id")
    a.add_argument("--quoted-column")
    a.add_argument("--max-text-length", type=int, default=1024)
    a.add_argument("--max-records", type=int)
    a.add_argument("--batch-size", type=int, default=100)
    a.add_argument("--output", help="also write batches of JSON lines here")
    a.add_argument("--dim", type=int, default=64)
    a.add_argument("--show-headers", action="store_true")
    s = sub.add_parser("search", help="nearest texts of a term")
    s.add_argument("term")
    s.add_argument("--store", required=True)
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--threshold", type=float)
    s.add_argument("--filter", type=json.loads)
    s.add_argument("--dim", type=int, default=64)
    return p


def process(spark, o: argparse.Namespace) -> dict:
    if not 100 <= o.max_text_length <= 10_240 or not 1 <= o.batch_size <= 1000:
        raise ValueError("text length must be 100 to 10240, batch size 1 to 1000")
    posts = etl.require(spark.read.parquet(o.path).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at")), o.id_column, o.text_column)
    rows = etl.first_of_key(etl.valid(posts, o.id_column, o.text_column), o.id_column, ["_at"])
    if o.quoted_column:
        rows = etl.with_quoted(rows, o.id_column, o.quoted_column, o.text_column, o.id_column)
    rows = rows.withColumn("key", F.col(o.id_column).cast("string"))
    store = VectorTable(spark, o.store, o.dim) if o.store else None
    if store and store._current():
        rows = etl.unknown(rows, store.read(), "key")
    if o.max_records:
        rows = rows.orderBy("key").limit(o.max_records)
    done = etl.processed(rows, o.text_column, "quoted_text" if o.quoted_column else None, o.max_text_length)
    if o.output:
        etl.batched(done.select("key", "content", "processing"), ["key"], o.batch_size).write.partitionBy("batch_file").json(o.output)
    if store and done.limit(1).count():
        store.upsert(generate(done, "key", "content", HashingEmbedder(o.dim)).join(done.select("key", F.struct(F.col("content").alias("text")).alias("metadata")), "key"))
    return etl.output_stats(done, o.text_column, "content").first().asDict()


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = session()
    if o.command == "search":
        found = search(VectorTable(spark, o.store, o.dim).read(), term=o.term, k=o.k, threshold=o.threshold, filter=o.filter, embedder=HashingEmbedder(o.dim), prefix="metadata")
        for r in found.select("key", F.format_number("distance", 4).alias("distance"), F.to_json("metadata").alias("metadata")).collect():
            print(r.distance, r.key, r.metadata)
    elif o.show_headers:
        etl.describe(spark.read.parquet(o.path)).show(1000, False)
    else:
        print(json.dumps(process(spark, o)))


if __name__ == "__main__":
    main()
