"""Command line: ``python -m quillmer.cli A.manifest B.manifest --work DIR``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from .params import Params


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmer", description="Compare two groups of samples by their k-mers and extract the reads that tell them apart.")
    p.add_argument("manifest_a")
    p.add_argument("manifest_b")
    p.add_argument("--work", required=True, help="folder of the stages' tables, shared by driver and executors")
    p.add_argument("--output", help="folder of the text outputs")
    p.add_argument("-M", "--mode", choices=list("KBCE"), default="K", help="stage to begin with: count, matrix, cluster, extract")
    p.add_argument("--only", action="store_true", help="run that stage alone")
    p.add_argument("--per-feature", action="store_true", help="test single k-mers instead of clusters")
    for f in fields(Params):
        p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans.pipeline import Pipeline
    from .sources.fastx import read_fastx
    from .sources.files import read_manifest

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillmer").getOrCreate()
    manifest = read_manifest(spark, a.manifest_a, a.manifest_b)
    reads = read_fastx(spark, [r.path for r in manifest.orderBy("sample_id").collect()])
    run = Pipeline(spark, reads, manifest, a.work, Params(**{f.name: getattr(a, f.name) for f in fields(Params)}))
    if a.per_feature:
        run.run("K", only=True)
        run.per_feature()
        return
    run.run(a.mode, a.only)
    if a.output:
        run.write_outputs(a.output)


if __name__ == "__main__":
    main()
