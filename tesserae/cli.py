"""Command line: list, annotate, checksum, combine."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import functions as fn
from .model import DEFAULT_METHOD, method_by_id
from .operators.checksum import checksum_tasks, file_checksum
from .plans import plan_tasks, split_prefix, totals
from .session import checkpoint, session
from .sources import list_files, read_tasks
from .sources.sinks import combine_lines, write_annotations, write_task_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tesserae", description="Describe large datasets: list objects, plan tasks, checksum and combine.")
    p.add_argument("--root", default="s3://", help="folder or store that holds the buckets")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("list", help="list objects and plan tasks")
    a.add_argument("prefix", help="bucket/key-prefix")
    a.add_argument("--task-dir")
    a.add_argument("--method-id", default=DEFAULT_METHOD)
    a = sub.add_parser("annotate", help="checksum the tasks of a task file or folder")
    a.add_argument("task_file")
    a.add_argument("output_file", nargs="?", default="annotations")
    a = sub.add_parser("checksum", help="checksum an object or a byte range of it")
    a.add_argument("url")
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--length", type=int)
    a = sub.add_parser("combine", help="annotation files into one, in order")
    a.add_argument("inputs", nargs="+")
    a.add_argument("output")
    o = p.parse_args(argv)
    at = lambda *parts: "/".join([o.root.rstrip("/") if not o.root.endswith("://") else o.root[:-1], *parts])
    if o.command == "checksum":
        bucket, _, key = o.url.replace("s3://", "").partition("/")
        path = at(bucket, key)
        print(f"Checksum: {file_checksum(path, o.offset, o.length)}")
        return 0
    spark = session()
    if o.command == "list":
        bucket, prefix = split_prefix(o.prefix)
        method = method_by_id(o.method_id)
        objects = checkpoint(list_files(spark, bucket, at(bucket), prefix))
        for row in objects.orderBy("key").select(fn.listing_line(F.col("bucket"), F.col("key"), F.col("size"), F.col("last_modified"), F.coalesce("etag", F.lit("-"))).alias("v")).toLocalIterator():
            print(row.v)
        if o.task_dir:
            write_task_files(plan_tasks(objects, method), o.task_dir)
        t = totals(objects).select(fn.human_size(F.col("total_size")).alias("size"), "num_files").first()
        print(f"Total size: {t.size} in {t.num_files} files")
    elif o.command == "annotate":
        write_annotations(checksum_tasks(read_tasks(spark, o.task_file), at().rstrip("/")), o.output_file)
        print(f"Wrote annotations to {o.output_file}")
    else:
        combine_lines(spark, o.inputs, o.output)
        print(f"Wrote {o.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
