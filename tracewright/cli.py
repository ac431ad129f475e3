"""Command line: scan a folder of packages, a file, an archive or a repository url."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import functions as F

from tracewright.plans.scan import scan
from tracewright.session import build_session
from tracewright.sources import packages, reports

# The exit code of a label.
EXIT_CODES = {"MALICIOUS": 2, "DANGEROUS": 2, "SUSPICIOUS": 1, "UNVERIFIED": 1, "NO_FINDINGS": 0}


def main(argv: list[str] | None = None) -> int:
    """Print a report for each package; the gravest label gives the exit code."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source", help="folder whose children are packages, one file, .zip or .tar(.gz), or a repository url")
    parser.add_argument("--json", action="store_true", help="JSON instead of Markdown")
    parser.add_argument("--master", default=None)
    options = parser.parse_args(argv)
    spark = build_session(master=options.master)
    source = options.source
    if source.startswith(("http://", "https://")):
        url = spark.range(1).select(packages.repository_url(F.lit(source)).alias("url")).first().url
        if url is None:
            parser.error("not a repository url that is accepted")
        folder = tempfile.mkdtemp()
        packages.clone(url, f"{folder}/package")
        files = packages.from_folder(spark, f"file://{folder}")
    elif source.endswith((".zip", ".tar", ".tar.gz", ".tgz")):
        read = spark.read.format("binaryFile").load(source)
        files, refused = packages.from_archives(read.select(F.substring_index("path", "/", -1).alias("pkg_id"), "content"))
        for r in refused.toLocalIterator():
            print(f"{r.pkg_id}: refused, {r.reason}")
    elif packages.is_file(spark, source):
        files = packages.from_file(spark, source)
    else:
        files = packages.from_folder(spark, source)
    done = scan(files)
    written = reports.as_json(done) if options.json else reports.as_markdown(done)
    for r in written.orderBy("pkg_id").toLocalIterator():
        print(r.report)
    labels = [r.label for r in done.verdicts.select("label").distinct().collect()]
    return max((EXIT_CODES[x] for x in labels), default=0)


if __name__ == "__main__":
    raise SystemExit(main())
