"""Requests for scans: which are refused and why, which a stored report answers, which are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.judge import PROVIDERS
from tracewright.sources import packages, reports

REQUEST = "request_id string, kind string, name string, text string, content binary, url string, force boolean, llm_provider string, llm_api_key string"
OK, BAD, TOO_LARGE = 200, 400, 413


def own_key() -> Column:
    """Whether a request brings the caller's own key for a judge."""
    return F.coalesce(F.length("llm_api_key"), F.lit(0)) > 0


def checked(requests: DataFrame) -> DataFrame:
    """(request_id, status, reason, address, name, use_store) of `requests` (REQUEST; kind: text, upload, repository).

    The address of a request is that of its bytes, for a repository those of its rebuilt url; it is null where the
    request is refused. A forced request, or one with an own key, neither reads nor writes the store. A null force is
    false; a null or blank name is that of a root document.
    """
    kind, blank = F.col("kind"), F.trim(F.coalesce("text", F.lit(""))) == ""
    url = packages.repository_url(F.coalesce("url", F.lit("")))
    unknown = own_key() & ~F.coalesce(F.col("llm_provider").isin(*PROVIDERS), F.lit(False))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    refused = (
        F.when(~F.coalesce(kind.isin("text", "upload", "repository"), F.lit(False)), F.lit("unknown kind"))
        .when((kind == "text") & F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"(?U)^\s*$")) | (kind == "text") & blank, F.lit("text is empty"))
        .when((kind == "repository") & url.isNull(), F.lit("not a repository url that is accepted"))
        .when(unknown, F.lit("unknown provider"))
        .when((kind == "upload") & (size > packages.MAX_UPLOAD), F.lit("upload beyond its bound"))
    )
    data = F.when(kind == "text", F.encode("text", "UTF-8")).when(kind == "upload", F.coalesce("content", F.lit(b""))).otherwise(F.encode(url, "UTF-8"))
    status = F.when(refused.isNull(), F.lit(OK)).when(refused == "upload beyond its bound", F.lit(TOO_LARGE)).otherwise(F.lit(BAD))
    name = F.trim(F.coalesce("name", F.lit("")))
    return requests.select(
        "request_id", status.alias("status"), refused.alias("reason"), F.when(refused.isNull(), reports.report_id(data)).alias("address"),
        F.when(name == "", F.lit(packages.ROOT_DOCUMENT)).otherwise(name).alias("name"), (~F.coalesce("force", F.lit(False)) & ~own_key()).alias("use_store"),
    )


def dealt(asked: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, to_scan) of `checked` requests that are not refused: those whose report is stored and may be used, and the rest."""
    fine = asked.where(F.col("status") == OK)
    known = stored.select(F.col("report_id").alias("address")).distinct()
    may = fine.where("use_store")
    return may.join(known, "address", "left_semi"), may.join(known, "address", "left_anti").unionByName(fine.where("not use_store"))
