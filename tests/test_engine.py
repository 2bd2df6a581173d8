import json
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as e
from palimpsest.config import Settings, cache_identity, final_limits
from palimpsest.functions.metrics import bleu, rouge_l, words
from palimpsest.functions.models import completed, hashing_embedding, with_retries
from palimpsest.operators import closest
from palimpsest.operators.cluster import average_linkage, with_small_merged
from palimpsest.operators.packet import packet
from palimpsest.plans import catalog
from palimpsest.sources import dialogues, state
from palimpsest.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_plan_has_sql():
    assert set(catalog.PLANS) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", ["turn_tokens", "unique_preserve_order", "heuristic_keywords", "session_segments", "evenly_spaced_turns", "bm25_topk", "hybrid_topk_static", "metric_aggregates", "question_type_accuracy", "evidence_suffix_join"])
def test_plan_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.run(spark, SF, name)
    want = con.sql(catalog.oracle(name))
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm([tuple(r[c] for c in cols) for r in got.collect()]) == norm(want.select(*cols).fetchall())


def test_settings():
    assert Settings.of({"semantic_weight": 2.0, "lexical_weight": 1.0, "recency_weight": 1.0}).semantic_weight == 0.5
    assert Settings(semantic_weight=0, lexical_weight=0, recency_weight=0).semantic_weight == 0.68
    assert Settings(high_multiplier=10).high_multiplier == 3.0
    assert Settings(turns=9).signature() != Settings().signature()
    assert Settings(turns=9).signature(False) == Settings().signature(False)
    for bad in ({"nope": 1}, {"low_threshold": 0.8}, {"window_mode": "odd"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
    assert cache_identity({"dataset": "a b", "x": 1}).startswith("a_b-")


def test_final_limits():
    assert final_limits(1, 3, 5, 1.55) == (2, 5, 8)
    assert final_limits(1, 3, 5, 1.0, 7) == (1, 3, 3)
    assert final_limits(1, 3, 5, 1.0, 0) == (0, 0, 0)


def test_average_linkage_is_not_single_linkage():
    x = np.array([0.0, 0.25, 0.5])
    assert average_linkage(np.abs(x[:, None] - x), 0.3) == [[0, 1], [2]]
    assert average_linkage(np.zeros((0, 0)), 0.3) == []


def test_small_clusters_join_similar_ones():
    v = np.array([[1.0, 0.0], [1.0, 0.0], [0.65, 0.76], [0.0, 1.0]])
    assert with_small_merged(v, [[0, 1], [2], [3]]) == [[0, 1, 2], [3]]


def test_metrics():
    assert rouge_l(words("a b c"), words("a c")) == pytest.approx(0.8)
    assert rouge_l([], ["a"]) == 0.0
    assert bleu(["a", "b"], ["a", "b"], (0.5, 0.5)) == pytest.approx(1.0)
    assert bleu(["x"], ["y"], (1.0,)) == 0.0


def test_models(spark):
    assert sum(x * x for x in hashing_embedding("a b a")) == pytest.approx(1.0)
    assert hashing_embedding("") == [0.0] * 256
    tries = []
    with pytest.raises(ZeroDivisionError):
        with_retries(lambda: tries.append(1) or 1 / 0, attempts=3, sleep=lambda s: None)
    assert len(tries) == 3
    assert completed(spark.createDataFrame([("p",)], "prompt string")).collect()[0]["reply"] == ""


def test_packet(spark):
    rows = [(1, 1, "turn", 10, 0.9, ["a", "b"]), (1, 2, "turn", 11, 0.8, ["a", "b"]), (1, 3, "topic", 12, 0.7, ["c"]), (1, 4, "turn", 13, 0.6, ["d"])]
    df = spark.createDataFrame(rows, "qid long, rnk int, layer string, id long, score double, toks array<string>")
    got = [(r["evidence_id"], r["id"]) for r in packet(df, {"turn": 2, "topic": 1}).orderBy("evidence_id").collect()]
    assert got == [("E01", 10), ("E02", 12), ("E03", 13)]


def test_sample_reader(spark, tmp_path):
    turn = {"speaker": "A", "dia_id": "D1:1", "text": "", "img_url": ["u"], "blip_caption": "a cat"}
    conv = {"speaker_a": "A", "session_1": [turn, turn | {"text": "hi", "dia_id": "D1:2"}], "session_1_date_time": "1 May 2023", "session_2": [turn]}
    p = tmp_path / "x.json"
    p.write_text(json.dumps([{"qa": [{"question": "q", "answer": "a", "evidence": ["D1:1"], "category": 5}], "conversation": conv}]))
    got = [(r["session_id"], r["turn_idx"], r["text"]) for r in dialogues.sample_turns(spark, str(p)).orderBy("turn_idx").collect()]
    assert got == [("1", 0, "[Image: a cat]"), ("1", 1, "[Image: a cat] hi")]
    assert dialogues.sample_questions(spark, str(p)).first()["category"] == 5
    assert dialogues.kind(spark, str(p)) == "samples"


def test_haystack_reader(spark, tmp_path):
    row = {"question_id": "7_abs", "question_type": "t", "question": "q", "question_date": "d", "answer": "a", "answer_session_ids": ["s"], "haystack_dates": ["d1"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": None}]]}
    p = tmp_path / "y.json"
    p.write_text(json.dumps([row]))
    q = dialogues.haystack_questions(spark, str(p))
    assert q.first()["is_abstention"]
    assert [r["dia_id"] for r in dialogues.haystack_turns(q).orderBy("turn_idx").collect()] == ["s1_1", "s1_2"]
    p.write_text(json.dumps([row | {"haystack_dates": []}]))
    with pytest.raises(Exception, match="differ in length"):
        dialogues.haystack_questions(spark, str(p)).collect()


def test_state_round_trip(spark, tmp_path):
    notes, edges = spark.createDataFrame([("turn", 1, "x")], "layer string, ord long, content string"), spark.createDataFrame([(1, 2)], "a long, b long")
    assert state.load(spark, f"{tmp_path}/m", Settings()) is None
    state.save(notes, edges, f"{tmp_path}/m", Settings())
    assert state.load(spark, f"{tmp_path}/m", Settings(turns=9))[0].count() == 1
    assert state.load(spark, f"{tmp_path}/m", Settings(cluster_distance=0.5)) is None


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"session_id": "s", "turn_idx": i, "speaker": "u", "text": f"t{i}", "is_end": False} for i in range(3)] + [{"session_id": "s", "turn_idx": 3, "is_end": True}]
    for i, part in enumerate((rows[:2], rows[2:], rows[:1])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i * 10,) * 2)  # the stream takes older files first
    turns = spark.readStream.schema(ingest.TURNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.ingest(turns, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = ingest.closed_sessions(spark, str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["n"] == 3 and got[0]["contents"][0] == "Speaker u says: t0"
    assert ingest.due_for_reclustering(20, 4) and not ingest.due_for_reclustering(19, 4)


def _tables(spark, tmp_path, turns, benchmark=((0, "What about w3?"),)):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_long_conversations_keep_their_turns_apart(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(c, t, "user", f"w{t} ~ tilde") for c, n in ((0, 120), (1, 30)) for t in range(n)])
    docs = catalog.run(spark, sf, "turn_documents").collect()
    assert len(docs) == 150 == len({r["ord"] for r in docs})
    assert catalog.run(spark, sf, "session_segments").count() == 30 + 8
    summaries = [r["summary"] for r in catalog.run(spark, sf, "episode_fallback_summary").collect()]
    assert len(summaries) == 38 and all(x.count("~ tilde") == x.count("- user:") for x in summaries)
    assert catalog.run(spark, sf, "layer_counts").filter("layer = 'turn'").first()["n"] == 150


def _reference_agreement(tops):
    pairs = [(a, b) for i, a in enumerate(tops) for b in tops[i + 1 :]]
    return sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs) if pairs else 1.0


def test_routing_by_hand(spark, tmp_path):
    """Uncertainty, agreement and the tier of one question, from cosines that plain code computes."""
    import hashlib
    import math
    import re
    from collections import Counter

    turns = [(c, t, "user", f"alpha{c} beta{t} gamma {'delta' * (t % 3)}") for c in range(3) for t in range(6)]
    question = "alpha1 beta2 gamma delta one two three four five six seven"
    sf = _tables(spark, tmp_path, turns, [(0, question)])
    docs = {r["ord"]: r["doc"] for r in catalog.run(spark, sf, "turn_documents").collect()}
    vector = lambda x: Counter(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 256 for t in re.findall("[a-z0-9]+", x.lower()))
    wide, nodes = 1 << 32, {"turn": {}, "episode": {}, "topic": {}}
    for o, x in docs.items():
        c, t = divmod(o, wide)
        for layer, k in (("turn", o), ("episode", c * wide + t // 4), ("topic", c % 10 % 3)):
            nodes[layer][k] = nodes[layer].get(k, Counter()) + vector(x)
    tokens = re.findall("[a-z0-9]+", question.lower())
    queries = [vector(question), vector(" ".join(tokens[:8])), vector(" ".join(tokens[-8:]))]
    cos = lambda a, b: sum(a[k] * b[k] for k in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    u, agree = {}, []
    for layer, own in nodes.items():
        tops, us = [], []
        for q in queries:
            s = sorted(((-round(cos(q, v), 9), k) for k, v in own.items()))[:8]
            x = [cos(q, own[k]) for _, k in s]
            e = [math.exp((y - x[0]) / 0.08) for y in x]
            p = [y / sum(e) for y in e]
            margin = min(1, (x[0] - x[1]) / 0.08)
            entropy = -sum(y * math.log(y + 1e-12) for y in p) / math.log(len(p))
            us.append(min(1, max(0, 0.45 * (1 - margin) + 0.35 * min(1, entropy) + 0.2 * (1 - p[0]))))
            tops.append({k for _, k in s[:5]})
        u[layer] = sum(us) / 3
        agree.append(_reference_agreement(tops))
    mean = 0.25 * u["topic"] + 0.30 * u["episode"] + 0.45 * u["turn"]
    got = catalog.run(spark, sf, "budget_profile").first()
    assert got["mean_uncertainty"] == pytest.approx(mean, abs=1e-5)
    assert got["agreement"] == pytest.approx(sum(agree) / 3, abs=1e-5)
    assert got["routing"] == pytest.approx(0.8 * mean + 0.2 * (1 - sum(agree) / 3), abs=1e-5)
    assert got["turn_focus"] == pytest.approx(u["turn"] - 0.5 * (u["topic"] + u["episode"]), abs=1e-5)


def test_guard_names_the_first_rule(spark):
    rows = {r["question_id"]: r for r in catalog.run(spark, SF, "reuse_guard").collect()}
    want = {0: "ok", 1: "question_mismatch", 2: "question_date_mismatch", 4: "reference_mismatch", 6: "model_mismatch", 11: "retrieve_k_mismatch", 17: "incomplete_prediction", 18: "incomplete_query_plan", 19: "incomplete_evidence", 20: "source_judge_disabled", 21: "incomplete_judge", 22: "judge_block_model_mismatch", 23: "no_source_record"}
    for k, reason in want.items():
        got = [r for q, r in rows.items() if q % 24 == k]
        assert got and all(r["reason"] == reason for r in got)
        assert all((r["answer_ok"], r["judge_ok"]) == ((1, 1) if reason == "ok" else (1, 0) if k in (20, 21, 22) else (0, 0)) for r in got)


def test_fingerprint(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    assert state.fingerprint(spark, str(tmp_path / "f")) == hashlib.sha1(b"abc").hexdigest()[:12]


@pytest.mark.parametrize("case", ["double", "float", "usual"])
def test_closest_equals_the_join_of_all_pairs(spark, tmp_path, monkeypatch, case):
    """Copies, repeated ids, near ties, vectors without a norm and odd ones; pairs of usual vectors are never rows."""
    for name, x in {"QUERIES": 8, "OTHERS": 16, "SUMS": 40, "PART_BYTES": 3000}.items():
        monkeypatch.setattr(closest, name, x)
    r = np.random.default_rng(4)
    v = r.normal(size=(260, 5))
    v[50:120] = v[50] * (1 + np.arange(70)[:, None] % 3)
    v[120:150] = v[50] + r.normal(size=(30, 5)) * 1e-5
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, v[7].tolist()), (60, v[50].tolist()), (61, v[50].tolist())]
    if case != "usual":
        rows += [(-10, None), (-7, None), (-7, [0.0] * 5), (300, [1.0, None, 1.0, 1.0, 1.0]), (310, [0.0] * 5), (311, []), (320, [1.0, 2.0]), (330, [float("nan")] * 5), (331, [float("inf")] + [1.0] * 4), (None, [1.0] * 5)]
    spark.createDataFrame(rows, f"vec_id long, embedding array<{'float' if case == 'float' else 'double'}>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = e.queries()["cosine_topk"](spark, str(tmp_path))
    want = catalog.run(spark, str(tmp_path), "cosine_topk")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and (case != "usual" or "NestedLoopJoin" not in plan)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
