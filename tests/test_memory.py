"""The facade and the command line, end to end on a folder of their own."""

import io
import json

import pytest
from pyspark.sql import functions as F

from mnemolith.__main__ import main
from mnemolith.memory import TABLES, Memory
from mnemolith.operators.session import Budget

TURNS = [("s1", 0, "user", "The database port is 5432 and the token expires daily"), ("s1", 1, "assistant", "Noted: database port 5432"), ("s2", 0, "user", "Layout of the button is wrong"), ("s2", 1, "tool", "")]


def axes(texts):
    """Three axes of topics."""
    words = (("auth", "token"), ("database", "sqlite"), ("layout", "button"))
    return [[float(any(w in t.lower() for w in ws)) or 0.01 for ws in words] for t in texts]


@pytest.fixture
def memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), axes, "axes", 3)
    m.store_session(spark.createDataFrame(TURNS, "session_id string, turn long, role string, text string"), "a", 100.0)
    return m


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_store_and_search(spark, memory):
    again = spark.createDataFrame(TURNS, "session_id string, turn long, role string, text string")
    before = memory.counts()
    memory.store_session(again, "a", 200.0)
    assert memory.counts() == before and before["messages"] == 4 and before["items"] == 3 and before["embeddings"] == 3
    hit = memory.search(ask(spark, "button"), "a").first()
    assert (hit.session_id, hit.turn) == ("s2", 0) and memory.search(ask(spark, "button"), "other").count() == 0
    found = memory.recall(ask(spark, "sqlite"), "a", 5).orderBy("rank").collect()
    assert found and "database" in found[0].preview
    assert {r.session_id: r.messages for r in memory.sessions().collect()} == {"s1": 2, "s2": 2}


def test_lifecycle(spark, memory):
    wrong = memory.table("items").where("source_id = 's1:0'").first().item_id
    new = memory.correct("a", "The database port is 5433", wrong, 300.0)
    rows = {r.item_id: r for r in memory.table("items").collect()}
    assert rows[wrong].confidence == "low" and rows[wrong].superseded_by == [new] and rows[wrong].valid_to == 300.0 and rows[new].supersedes == [wrong]
    other = memory.table("items").where("source_id = 's2:0'").first().item_id
    claim = memory.contradict("a", "The button layout is right", [other], 400.0)
    assert memory.find_contradictions("button").count() == 2 and memory.table("items").where(F.col("item_id") == other).first().contradicted_by == [claim]
    with pytest.raises(KeyError):
        memory.contradict("a", "nothing", ["zzz"], 1.0)
    best = memory.active_recall(session_id="s1").orderBy("rank").collect()
    assert best[0].item_id == new and wrong not in {r.item_id for r in best}
    memory.index(spark.createDataFrame([("a", "fact", "f1", None, "v1", "color")], "agent_id string, source_type string, source_id string, session_id string, text string, merge_key string"), 500.0)
    memory.index(spark.createDataFrame([("a", "fact", "f2", None, "v2", "color")], "agent_id string, source_type string, source_id string, session_id string, text string, merge_key string"), 600.0)
    f = {r.source_id: r for r in memory.table("items").where("merge_key = 'color'").collect()}
    assert f["f1"].valid_to == 600.0 and f["f1"].superseded_by == [f["f2"].item_id] and f["f2"].supersedes == [f["f1"].item_id]


def test_documents(spark, memory):
    text = "\n\n".join("Paragraph %d about the parser. " % i + "word " * 120 for i in range(15))
    docs = spark.createDataFrame([("d.md", text)], "name string, content string")
    first = memory.load(docs, "a", 100.0, 1000, 100).first()
    counts = memory.counts()
    assert not first.deduped and memory.load(docs, "a", 200.0, 1000, 100).first().deduped and memory.counts() == counts
    assert not memory.load(docs, "a", 300.0, 2000, 0).first().deduped
    assert memory.search_chunks(ask(spark, "parser"), first.buffer_id, 3).count() == 3
    ids = [f"{first.buffer_id}_{i}" for i in (2, 0)]
    assert [r.chunk_id for r in memory.chunk(ids).collect()] == ids
    n = memory.table("chunks").where(F.col("buffer_id") == first.buffer_id).count()
    assert memory.dispatch(first.buffer_id, 4).count() == -(-n // 4) and memory.dispatch(first.buffer_id).count() == 1
    run = memory.analyse(buffer_id=first.buffer_id).first()
    assert run.fits and run.chunk_ids == list(range(n)) and memory.table("results").count() == -(-n // 4)
    memory.analyse(buffer_id=first.buffer_id)
    assert memory.log("results").count() == -(-n // 4)
    kinds = {r.source_type: r["count"] for r in memory.table("items").groupBy("source_type").count().collect()}
    assert kinds == {"message": 3, "rlm_chunk": memory.table("chunks").count(), "rlm_analysis": -(-n // 4), "rlm_summary": 1}
    memory.vacuum("items")
    assert memory.log("items").count() == memory.table("items").count() == sum(kinds.values())


def test_compaction(spark, memory):
    turns = spark.createDataFrame([("long", i, "user", f"fact {i} file_abcd{i:02d} " + "long text " * 150) for i in range(8)], "session_id string, turn long, role string, text string")
    memory.store_session(turns, "a", 100.0)
    assert memory.compact(Budget(10**6), at=1.0).count() == 0
    done = memory.compact(Budget(2500, 100, 100), at=200.0).collect()
    assert [(r.session_id, r.rounds, len(r.summaries), r.effective) for r in done] == [("long", 1, 1, True)]
    view = memory.view().where("session_id = 'long'").orderBy("position").collect()
    assert [r.item_type for r in view] == ["summary", "message", "message"] and "file_abcd03" in view[0].text and memory.messages().where("session_id = 'long'").count() == 8
    kept = memory.context(1000).where("session_id = 'long'").collect()
    assert sum(r.tokens + 5 for r in kept) <= 1000 and any(r.item_type == "summary" for r in kept)
    parts = memory.bundle("long", ask(spark, "fact"), "a")
    assert parts["messages"].count() == 3 and parts["policy"].first().policy in ("full", "champion", "snippet", "preview", "trimmed") and parts["provenance"].count() > 3


def test_compaction_again(spark, memory):
    """Summaries of summaries, old tool outputs noted only, contexts cut to any limit."""
    part = "struct<part_type string, content string, tool_name string, tool_call_id string, tool_state string>"
    rows = [("w", i, "user" if i % 2 == 0 else "assistant", f"fact {i} " + "long text " * 60, [("tool", f"out {i} " + "x" * 900, "grep", f"c{i}", "completed"), ("text", f"fact {i} " + "long text " * 60, None, None, None)] if i % 2 else None) for i in range(6)]
    more = [("w", i, "user" if i % 2 == 0 else "assistant", f"late {i} " + "more words " * 60, None) for i in range(6, 14)]
    kind = f"session_id string, turn long, role string, text string, parts array<{part}>"
    memory.store_session(spark.createDataFrame(rows, kind), "a", 100.0)
    assert memory.table("parts").where("session_id = 'w'").count() == 9 and memory.search(ask(spark, "grep"), "a").count() == 3
    tight = Budget(800, 0, 0)
    first = memory.compact(tight, at=200.0, protect_tokens=100, least=50).where("session_id = 'w'").first()
    assert first.rounds == 1 and memory.table("parts").where("compacted_at is not null").count() > 0
    memory.store_session(spark.createDataFrame(more, kind), "a", 300.0)
    second = memory.compact(tight, at=400.0, protect_tokens=100, least=50).where("session_id = 'w'").first()
    assert second.rounds == 2 and second.after < second.before
    sums = {r.summary_id: r for r in memory.table("summaries").where("session_id = 'w'").collect()}
    assert sorted(r.level for r in sums.values()) == [0, 0, 1] and sum(r.superseded for r in sums.values()) == 2
    top = next(r for r in sums.values() if r.level == 1)
    assert sorted(top.children) == sorted(i for i, r in sums.items() if r.superseded)
    view = memory.view().where("session_id = 'w'").orderBy("position").collect()
    assert [r.item_type for r in view].count("summary") == 1 and view[0].text.startswith("[LCM summary node sum_")
    for budget in (20, 60, 200):
        kept = memory.context(budget, "Be brief. " * 30).where("session_id = 'w'").collect()
        assert sum(r.tokens + 5 * (r.role != "system") for r in kept) <= budget
    memory.vacuum("context")
    assert [r.item_id for r in memory.view().where("session_id = 'w'").orderBy("position").collect()] == [r.item_id for r in view]


def test_chunk_modes(spark, memory):
    docs = spark.createDataFrame([("a.md", "the sqlite file " * 90), ("b.md", "a button of the layout " * 70)], "name string, content string")
    memory.load(docs, "a", 100.0, 1000, 0)
    hits = {mode: memory.search_chunks(ask(spark, "database"), None, 4, mode).collect() for mode in ("bm25", "semantic", "hybrid")}
    assert not hits["bm25"] and hits["semantic"] and "sqlite" in min(hits["semantic"], key=lambda r: r.rank).preview and len(hits["hybrid"]) == len(hits["semantic"])
    assert memory.chunks(limit=3).count() == 3


def test_empty(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "none"))
    assert set(m.counts().values()) == {0} and len(m.counts()) == len(TABLES)
    assert m.recall(ask(spark, "x")).count() == 0 and m.active_recall().count() == 0 and m.context(10).count() == 0 and m.compact().count() == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "t.txt").write_text("[user]: remember the blue door\n[assistant]: the blue door, yes")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Notes\n" + "The river is wide. " * 200)

    def call(*args):
        out = io.StringIO()
        code = main(["--root", str(tmp_path / "m"), "--at", "5", *map(str, args)], spark, out)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    assert call("store-session", tmp_path / "t.txt", "--session-id", "s")[1][0]["messages"] == 2
    assert call("search", "door")[1][0]["session_id"] == "s" and call("recall-memory", "door")[1]
    assert call("index", tmp_path / "docs", "--chunk-size", 1000)[1][0]["deduped"] is False and call("ingest-file", tmp_path / "docs" / "a.md", "--chunk-size", 1000)[1][0]["deduped"] is True
    assert call("rlm-search", "river")[1] and call("rlm-run")[1][0]["fits"] and call("dispatch")[1] and call("chunk", tmp_path / "docs" / "a.md")[1]
    held = call("context-get")[1]
    assert held and call("rlm-record", held[0]["buffer_id"], 0, "other words")[1][0]["analysis"] != "other words"
    assert call("long-term-source", call("recall-memory", "door")[1][0]["id"])[1][0]["text"]
    fixed = call("record-correction", "the door is red")[1][0]["item_id"]
    assert call("record-contradiction", "the door is green", fixed)[0] == 0 and len(call("find-contradictions", "--query", "door")[1]) == 2
    assert call("record-contradiction", "x", "missing")[0] == 1
    assert call("active-recall")[1] and call("lcm-context", "--session-id", "s")[1] and call("lcm-messages")[1] and call("lcm-sessions")[1]
    assert {x["part"] for x in call("runtime-context", "s", "door")[1]} >= {"messages", "recall", "policy"} and call("counts")[1][0]["messages"] == 2
    assert call("lcm-compact")[0] == 0 and call("lcm-summary")[1] == []


def test_second_brain(spark, tmp_path):
    from mnemolith.checks import second_brain, verdict

    checks = second_brain(spark, str(tmp_path / "b")).cache()
    assert checks.count() == 13 and checks.where("not ok").collect() == []
    assert {r.dimension: r.passed for r in verdict(checks).collect()}["all"]
