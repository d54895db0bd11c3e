"""Command line: inspect, manifest, study-summary, visualize. Exits with 2 where a folder or study does not exist."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException

from sliceframe.plans import visualize
from sliceframe.plans.collection_catalog import Collection
from sliceframe.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sliceframe")
    p.add_argument("command", choices=["inspect", "manifest", "study-summary", "visualize"])
    p.add_argument("root", help="folder of DICOM files, on any file system that Spark reads")
    p.add_argument("--cache", help="Parquet folder for headers, written if absent")
    p.add_argument("--manifest", action="store_true", help="inspect: write manifests as well")
    p.add_argument("--dest", help="folder of what is written; manifests, or images below it by study")
    p.add_argument("--study")
    p.add_argument("--n-slices", type=int, default=visualize.SLICES, help="visualize: slices of each series")
    p.add_argument("--include-invalid", action="store_true", help="visualize: invalid series as well")
    p.add_argument("--window", action="store_true", help="visualize: clip to the window that a file names")
    a = p.parse_args(argv)
    if a.command in ("study-summary", "visualize") and not a.study:
        p.error(f"{a.command} needs --study")
    found = Collection(local_session(), a.root, a.cache)
    try:
        if a.command == "inspect":
            print(json.dumps(found.counts().first().asDict(), indent=2))
        if a.command == "manifest" or a.manifest:
            found.write_manifests(a.dest or "manifests")
        if a.command == "study-summary":
            row = found.study_summary(a.study).first().asDict()
            print(json.dumps(row | {"series": json.loads(row["series"])}, indent=2))
        if a.command == "visualize":
            print(json.dumps(found.visualize(a.study, a.dest or f"images/{a.study}", n_slices=a.n_slices, include_invalid=a.include_invalid, windowed=a.window), indent=2))
    except KeyError:
        print(f"unknown study: {a.study}", file=sys.stderr)
        return 2
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"no such folder: {a.root}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
