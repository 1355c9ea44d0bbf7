"""Command line: ``python -m mnemolith --root FOLDER COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.memory import Memory
from mnemolith.operators import chunking, session
from mnemolith.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemolith")
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--agent", default="default")
    p.add_argument("--at", type=float, default=None, help="time of a write in epoch seconds (now)")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args, **options):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), default=v, type=str if v is None else type(v))
        return s

    add("store-session", "path", session_id=None)
    add("search", "query", top_k=10)
    add("recall-memory", "query", top_k=10)
    add("active-recall", limit=8, session_id=None)
    add("record-correction", "statement", wrong_id=None)
    add("record-contradiction", "statement", "items")
    add("find-contradictions", query=None, top_k=10)
    add("index", "folder", max_files=1000, chunk_size=4000, overlap=200)
    add("ingest-file", "path", chunk_size=4000, overlap=200)
    add("rlm-load", "path", chunk_size=4000, overlap=200)
    add("rlm-search", "query", buffer_id=None, top_k=10, mode="bm25")
    add("rlm-record", "buffer_id", "batch_index", "analysis", batch_size=4)
    add("context-get", buffer_id=None, limit=100)
    add("long-term-source", "items")
    add("rlm-chunk-get", "ids")
    add("chunk", "path", chunk_size=4000, overlap=200)
    add("dispatch", buffer_id=None, batch_size=4)
    add("rlm-run", buffer_id=None, batch_size=4)
    add("aggregate", buffer_id=None)
    add("lcm-context", session_id=None, budget=session.Budget().hard, system_prompt="")
    add("lcm-sessions")
    add("lcm-messages", session_id=None)
    add("lcm-summary", session_id=None)
    add("lcm-compact", limit=session.Budget().limit, keep=2)
    add("lcm-maintain", limit=session.Budget().limit, keep=2)
    add("runtime-context", "session_id", "query", budget=4000)
    add("counts")
    return p


def run(memory: Memory, a: argparse.Namespace):
    spark, at = memory.spark, time.time() if a.at is None else a.at
    asked = lambda q: spark.createDataFrame([(1, q)], "query_id long, query string")
    of_session = lambda df: df.where(F.col("session_id") == a.session_id) if a.session_id else df
    of_buffer = lambda df: df.where(F.col("buffer_id") == a.buffer_id) if a.buffer_id else df
    match a.command:
        case "store-session":
            if a.path.endswith(".json"):
                turns = files.session_files(spark, a.path).withColumnRenamed("content", "text")
            else:
                raw = files.read_documents(spark, a.path).select(F.element_at(F.split("source_path", "/"), -1).alias("session_id"), "content")
                turns = files.labelled_transcript(raw, "session_id", "content").withColumnRenamed("content", "text")
            turns = turns.withColumn("session_id", F.lit(a.session_id)) if a.session_id else turns
            memory.store_session(turns, a.agent, at)
            return memory.sessions().where(F.col("session_id").isin([r.session_id for r in turns.select("session_id").distinct().collect()]))
        case "search":
            return memory.search(asked(a.query), a.agent, a.top_k)
        case "recall-memory":
            return memory.recall(asked(a.query), a.agent, a.top_k)
        case "active-recall":
            return memory.active_recall(a.limit, a.session_id).where(F.col("agent_id") == a.agent)
        case "record-correction":
            return {"item_id": memory.correct(a.agent, a.statement, a.wrong_id, at)}
        case "record-contradiction":
            return {"item_id": memory.contradict(a.agent, a.statement, a.items.split(","), at)}
        case "find-contradictions":
            return memory.find_contradictions(a.query, a.top_k)
        case "index":
            found = files.discover_markdown(spark, a.folder, a.max_files)
            paths = [r.path for r in found.where("skipped is null").select("path").collect()]  # at most max_files
            if not paths:
                return {"files": 0}
            docs = files.read_documents(spark, paths).select(F.col("source_path").alias("name"), "content")
            return memory.load(docs, a.agent, at, a.chunk_size, a.overlap)
        case "ingest-file" | "rlm-load":
            docs = files.read_documents(spark, a.path).select(F.col("source_path").alias("name"), "content")
            return memory.load(docs, a.agent, at, a.chunk_size, a.overlap)
        case "rlm-search":
            return memory.search_chunks(asked(a.query), a.buffer_id, a.top_k, a.mode)
        case "rlm-record":
            return memory.record(a.buffer_id, int(a.batch_index), a.analysis, a.batch_size)
        case "context-get":
            return memory.chunks(a.buffer_id, a.limit)
        case "long-term-source":
            return memory.source(a.items.split(","))
        case "rlm-chunk-get":
            return memory.chunk(a.ids.split(","))
        case "chunk":
            return chunking.chunk_documents(files.read_documents(spark, a.path), "source_path", "content", a.chunk_size, a.overlap)
        case "dispatch":
            return memory.dispatch(a.buffer_id, a.batch_size)
        case "rlm-run":
            return memory.analyse(buffer_id=a.buffer_id, batch=a.batch_size)
        case "aggregate":
            return of_buffer(memory.table("results"))
        case "lcm-context":
            return of_session(memory.context(a.budget, a.system_prompt)).orderBy("session_id", "position")
        case "lcm-sessions":
            return memory.sessions()
        case "lcm-messages":
            return of_session(memory.messages()).select("session_id", "turn", "role", "tokens", fx.preview("text", 240, "...").alias("preview")).orderBy("session_id", "turn")
        case "lcm-summary":
            return of_session(memory.table("summaries"))
        case "lcm-compact" | "lcm-maintain":
            return memory.compact(session.Budget(limit=a.limit, output=0, buffer=0), a.keep, at, hard_only=a.command == "lcm-maintain")
        case "runtime-context":
            return memory.bundle(a.session_id, asked(a.query), a.agent, a.budget)
        case "counts":
            return memory.counts()


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("mnemolith").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = run(Memory(spark, a.root), a)
    except (KeyError, RuntimeError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=out)
        return 1
    parts = {"": result} if isinstance(result, DataFrame) else result
    if parts and all(isinstance(x, DataFrame) for x in parts.values()):
        for name, df in parts.items():
            for line in df.toJSON().toLocalIterator():
                print(line if not name else json.dumps({"part": name} | json.loads(line)), file=out)
    else:
        print(json.dumps(parts), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
