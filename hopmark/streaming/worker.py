"""The job worker: request documents in, labels, follow-up targets and a done marker out. Structured Streaming over a folder of any store."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from hopmark.operators.classify import classify_base
from hopmark.operators.merge import follow_up_targets
from hopmark.sources.manifest import load_config, measurement_protocol
from hopmark.sources.tables import digest, exists, listing, publish, read_text, scan, write_json

log = logging.getLogger(__name__)

VERSION = 1
#: Protocols, the shape of a job's name, and the name of the follow-up table.
PROTOCOLS = ("icmp", "tcp", "udp-dns")
JOB_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
TARGET_NAME = "zmap_unclassified.pq"
#: The fields of the two kinds of request documents, by the folder that holds their jobs.
FIELDS = {
    "jobs": ("version", "job_id", "protocol", "measurement_id", "ipid_uri", "snapshot_uri", "result_uri", "done_uri", "failed_uri", "created_at"),
    "analysis-jobs": ("version", "job_id", "protocol", "manifest_uri", "zmap_prefix", "os_prefix", "ipid_prefix", "done_uri", "failed_uri", "created_at"),
}


def join_uri(*parts: str) -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts))


def places(request: dict, prefix: str, kind: str) -> dict[str, str]:
    """Where the files that a request names have to stand."""
    job = join_uri(prefix, kind, request["job_id"])
    out = {"done_uri": join_uri(job, "done.json"), "failed_uri": join_uri(job, "failed.json")}
    if kind == "analysis-jobs":
        return out | {"manifest_uri": join_uri(job, "manifest.json")}
    home = request["ipid_uri"].removesuffix("/ipid.pq")
    return out | {"snapshot_uri": join_uri(home, "ipid.snapshot.yaml"), "result_uri": join_uri(home, TARGET_NAME)}


def complaints(request: dict, prefix: str, kind: str) -> Iterator[str]:
    """All that is wrong with a request document; later checks need that the ones before pass."""
    if wrong := {*request} ^ {*FIELDS[kind]}:
        yield f"fields missing or unknown: {', '.join(sorted(wrong))}"
        return
    texts = {k: v for k, v in request.items() if k != "version"}
    if not all(isinstance(v, str) for v in texts.values()):
        yield "all fields but the version are texts"
        return
    if request["version"] != VERSION:
        yield f"version {request['version']} instead of {VERSION}"
    if JOB_ID.fullmatch(request["job_id"]) is None:
        yield "job_id cannot be a folder's name"
        return
    if request["protocol"] not in PROTOCOLS or measurement_protocol(request["job_id"]) != request["protocol"]:
        yield f"protocol {request['protocol']} of job {request['job_id']}"
    if kind == "jobs":
        if request["measurement_id"] != request["job_id"]:
            yield "a job has the name of its measurement"
        if not request["ipid_uri"].endswith("/ipid.pq"):
            yield "ipid_uri names no ipid.pq"
    yield from (f"{k} is empty" for k in FIELDS[kind] if k.endswith("_prefix") and not request[k].partition("://")[2].strip("/") and not request[k].startswith("/"))
    yield from (f"{k} should be {uri}" for k, uri in places(request, prefix, kind).items() if request[k] != uri)


def checked(request: dict, prefix: str, kind: str = "jobs") -> dict:
    """The request, if nothing is wrong with it; else ValueError."""
    if wrong := [*complaints(request, prefix, kind)]:
        raise ValueError("; ".join(wrong))
    return request


def classify_request(spark: SparkSession, r: dict) -> None:
    """Labels and follow-up targets of one base measurement; the done marker comes last."""
    home = r["ipid_uri"].rpartition("/")[0]
    config = load_config(read_text(spark, r["snapshot_uri"]))
    labels = classify_base(scan(spark, r["ipid_uri"], ["IP_ADDR", "IPID_SEQUENCE"]), config, skip_first=r["protocol"] == "tcp")
    publish(labels, join_uri(home, "strategies.pq"))
    publish(follow_up_targets(spark.read.parquet(join_uri(home, "strategies.pq"))), r["result_uri"])
    rows = spark.read.parquet(r["result_uri"]).count()
    parts = listing(spark, join_uri(r["result_uri"], "*.parquet"))
    write_json(spark, r["done_uri"], {"version": VERSION, "job_id": r["job_id"], "result_uri": r["result_uri"], "rows": rows, **digest(spark, parts)})


def analyse_request(spark: SparkSession, r: dict) -> None:
    """A whole campaign: the manifest's runs, read in place, and its artifacts beside the markers."""
    from hopmark.plans.postprocess import Campaign

    raw = {r[k].rstrip("/").rpartition("/")[0] for k in ("zmap_prefix", "os_prefix", "ipid_prefix")}
    if len(raw) != 1:
        raise ValueError("zmap, os and ipid stand in different folders")
    out = r["done_uri"].rpartition("/")[0]
    units = Campaign(spark, json.loads(read_text(spark, r["manifest_uri"])), raw.pop(), join_uri(out, "artifacts")).run()
    failed = sorted(k for k, v in units.items() if v != "done")
    write_json(spark, r["done_uri"], {"version": VERSION, "job_id": r["job_id"], "units": len(units), "failed": failed})


PROCESS: dict[str, Callable[[SparkSession, dict], None]] = {"jobs": classify_request, "analysis-jobs": analyse_request}


def run_document(spark: SparkSession, text: str, job: str, prefix: str, kind: str) -> str:
    """One document of the folder `job`. A job with a marker is skipped; one that fails, or does not parse, gets failed.json."""
    done, failed = (join_uri(prefix, kind, job, f"{x}.json") for x in ("done", "failed"))
    if exists(spark, done) or exists(spark, failed):
        return "skipped"
    try:
        request = json.loads(text)
        if not isinstance(request, dict) or request.get("job_id") != job:
            raise ValueError(f"not a request document of job {job}")
        PROCESS[kind](spark, checked(request, prefix, kind))
        return "done"
    except Exception as e:  # each job stands alone
        log.exception("job %s failed", job)
        write_json(spark, failed, {"version": VERSION, "job_id": job, "error": str(e)})
        return f"failed: {e}"


def run_documents(spark: SparkSession, documents: list[tuple[str, str]], prefix: str) -> dict[str, str]:
    """Documents (URI, text) in the order of their URIs; one job's failure does not stop the next."""
    out = {}
    for uri, text in sorted(documents):
        kind, job = uri.split("/")[-3:-1]
        out[job] = run_document(spark, text, job, prefix, kind)
    return out


def watch(spark: SparkSession, prefix: str, checkpoint: str, once: bool = False, seconds: int = 30, kind: str = "jobs"):
    """Stream of <kind>/*/request.json: every new document once; --once takes what is there, else polls."""
    stream = spark.readStream.format("text").option("wholetext", True).load(join_uri(prefix, kind, "*/request.json")).selectExpr("_metadata.file_path AS uri", "value")

    def batch(df: DataFrame, _: int) -> None:
        run_documents(df.sparkSession, [tuple(r) for r in df.collect()], prefix)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
