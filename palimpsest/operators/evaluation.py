"""Evaluation: lexical metrics, majority votes, grouped aggregates and run summaries."""

from __future__ import annotations

from ..plans.dialect import Spark
from ..sources import tables

Step = tuple[str, str]
METRICS = ("em", "f1", "rouge1", "rouge2", "bleu1")


def words(d: Spark, x: str) -> str:
    return d.keep(f"regexp_split_to_array(translate(lower({x}), '.,!?', '    '), ' +')" if d.name == "duckdb" else f"split(translate(lower({x}), '.,!?', '    '), ' +')", "v <> ''")


def pairs(d: Spark) -> list[Step]:
    """A turn as the prediction of the next one, with the words of both."""
    return [*tables.turns(d), ("pairs", "SELECT a.ord AS pair_id, a.session_id, a.speaker AS kind, a.text AS pred, b.text AS ref FROM turns a JOIN turns b ON a.session_id = b.session_id AND b.turn_idx = a.turn_idx + 1"),
        ("worded", f"SELECT *, {words(d, d.sub('pred', '[\\t\\n\\r]', ' '))} AS p, {words(d, d.sub('ref', '[\\t\\n\\r]', ' '))} AS r FROM pairs")]


def _grams(d: Spark, side: str, n: int) -> list[Step]:
    name = f"{side}{n}"
    return [(f"{name}_x", d.explode("pair_id", side, "worded")),
        (f"{name}_g", f"SELECT pair_id, x AS g FROM {name}_x" if n == 1 else f"SELECT pair_id, concat(x, ' ', y) AS g FROM (SELECT pair_id, x, lead(x) OVER (PARTITION BY pair_id ORDER BY pos) AS y FROM {name}_x) z WHERE y IS NOT NULL"),
        (name, f"SELECT pair_id, g, count(*) AS c FROM {name}_g GROUP BY pair_id, g"), (f"{name}_n", f"SELECT pair_id, sum(c) AS n FROM {name} GROUP BY pair_id")]


def metrics(d: Spark) -> list[Step]:
    """Exact match, F1 of word sets, ROUGE-1 and ROUGE-2 F (unstemmed) and BLEU-1, for each pair."""
    both = d.common("p", "r")
    f = lambda m, a, b: f"CASE WHEN coalesce({m}, 0) = 0 THEN {d.n(0.0)} ELSE 2 * ({d.dbl(m)} / {a}) * ({d.dbl(m)} / {b}) / ({d.dbl(m)} / {a} + {d.dbl(m)} / {b}) END"
    steps = [*pairs(d)]
    for n in (1, 2):
        steps += [*_grams(d, "p", n), *_grams(d, "r", n), (f"hit{n}", f"SELECT p.pair_id, sum(least(p.c, r.c)) AS m FROM p{n} p JOIN r{n} r ON p.pair_id = r.pair_id AND p.g = r.g GROUP BY p.pair_id")]
    return [*steps, ("metrics", f"""SELECT w.pair_id, w.kind, CASE WHEN lower(trim(pred)) = lower(trim(ref)) THEN {d.n(1.0)} ELSE {d.n(0.0)} END AS em,
        {f(both, d.size(d.uniq('p')), d.size(d.uniq('r')))} AS f1, {f('h1.m', 'p1.n', 'r1.n')} AS rouge1, {f('h2.m', 'p2.n', 'r2.n')} AS rouge2,
        CASE WHEN coalesce(h1.m, 0) = 0 THEN {d.n(0.0)} ELSE {d.dbl('h1.m')} / p1.n * CASE WHEN p1.n > r1.n THEN {d.n(1.0)} ELSE exp(1 - {d.dbl('r1.n')} / p1.n) END END AS bleu1
        FROM worded w LEFT JOIN hit1 h1 ON w.pair_id = h1.pair_id LEFT JOIN hit2 h2 ON w.pair_id = h2.pair_id LEFT JOIN p1_n p1 ON w.pair_id = p1.pair_id LEFT JOIN r1_n r1 ON w.pair_id = r1.pair_id
        LEFT JOIN p2_n p2 ON w.pair_id = p2.pair_id LEFT JOIN r2_n r2 ON w.pair_id = r2.pair_id""")]  # fmt: skip


def long_metrics(d: Spark) -> list[Step]:
    return [*metrics(d), ("long_metrics", " UNION ALL ".join(f"SELECT pair_id, kind, '{m}' AS metric, {m} AS v FROM metrics" for m in METRICS))]


def judged(d: Spark) -> list[Step]:
    """Three judgments a document from its labels, a question type and a category from its source."""
    number = f"coalesce(TRY_CAST({d.first('source', '([0-9]+)$')} AS INT), 0)"
    types = ("single-session-user", "single-session-preference", "single-session-assistant", "multi-session", "temporal-reasoning", "knowledge-update")
    case = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(types))
    return [("question_types", " UNION ALL ".join(f"SELECT '{t}' AS question_type" for t in types)),
        ("judged", f"""SELECT l.doc_id, CASE {number} % 6 {case} END AS question_type, {number} % 4 + 1 AS category, quality AS j1, 1 - toxic AS j2, CAST(l.doc_id % 2 AS INT) AS j3, toxic AS abstention, text
        FROM {d.table('labels')} l JOIN {d.table('documents')} d ON l.doc_id = d.doc_id"""),
        ("votes", "SELECT *, CASE WHEN (j1 + j2 + j3) * 2 > 3 THEN 1 ELSE 0 END AS label FROM judged")]
