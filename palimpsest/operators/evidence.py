"""Evidence: sufficiency, escalation, candidate scores, packets without near-duplicates, rendering."""

from __future__ import annotations

import re

from ..functions import text
from ..plans.dialect import Spark
from ..sources import tables
from .retrieval import provenance

Step = tuple[str, str]
MOST_ALIKE = 0.85


def _signal(d: Spark, x: str) -> str:
    return "(" + " OR ".join(d.like(f"lower({x})", p) for p in (text.YEAR, text.DATE, text.CLOCK)) + ")"


def episode_texts(d: Spark) -> list[Step]:
    """Summaries that need no model: a header and an episode's first eight turns; titles from their first lines."""
    return [*tables.episodes(d),
        ("bullets", f"SELECT episode_id, {d.lines('line', 'pos')} AS body FROM (SELECT episode_id, pos, concat('- ', speaker, ': ', content) AS line FROM placed WHERE pos < 8) x GROUP BY episode_id"),
        ("episode_texts", f"""SELECT e.sample_id, e.topic_id, e.episode_id, concat('Episode summary. Episode: ', nth, '/', of_all, '. Date: ', ts_raw, '. ', {d.line()}, 'Episode summary on ', ts_raw, {d.line()}, body) AS summary
        FROM episodes e JOIN bullets b ON e.episode_id = b.episode_id"""),
        ("episode_titled", f"SELECT *, CASE WHEN lower(trim({text.first_sentence(d, 'summary')})) = 'general' THEN concat('Episode ', episode_id) ELSE {d.head(d.sub('summary', '[ \\t\\n]+', ' '), 96)} END AS title FROM episode_texts")]


def memory_texts(d: Spark) -> list[Step]:
    return [*provenance(d), *episode_texts(d),
        ("topic_texts", f"SELECT topic_id, {d.listed('title', ' ', 'episode_id')} AS body FROM episode_titled GROUP BY topic_id"),
        ("found", """SELECT m.qid, m.layer, m.id, m.s, m.rnk, coalesce(t.content, e.summary, p.body) AS content FROM memories m LEFT JOIN turns t ON m.layer = 'turn' AND m.id = t.ord
        LEFT JOIN episode_texts e ON m.layer = 'episode' AND m.id = e.episode_id LEFT JOIN topic_texts p ON m.layer = 'topic' AND m.id = p.topic_id""")]  # fmt: skip


def sufficiency(d: Spark, k: int = 10) -> list[Step]:
    """How much a question's memories support an answer, and whether to search again."""
    low = max(2, min(4, k // 2))
    return [*memory_texts(d), ("asked_for", f"SELECT qid, question, {text.entities(d, text.ascii_only(d, 'question'))} AS names FROM qa"),
        ("support", f"""SELECT f.qid, max(CASE WHEN {d.any('q.names', d.inside('lower(f.content)', 'lower(v)'))} THEN 1 ELSE 0 END) AS named, sum(CASE WHEN layer = 'turn' THEN 1 ELSE 0 END) AS turns, sum(CASE WHEN layer = 'episode' THEN 1 ELSE 0 END) AS episodes, sum(CASE WHEN layer = 'topic' THEN 1 ELSE 0 END) AS topics,
        max(CASE WHEN {_signal(d, 'content')} THEN 1 ELSE 0 END) AS dated FROM found f JOIN asked_for q ON f.qid = q.qid GROUP BY f.qid"""),
        ("flags", f"SELECT s.*, CASE WHEN {_signal(d, 'q.question')} THEN 1 ELSE 0 END AS temporal, CASE WHEN {d.size('q.names')} = 0 OR s.named = 1 THEN 1 ELSE 0 END AS lexical_ok FROM support s JOIN asked_for q ON s.qid = q.qid"),
        ("supported", "SELECT *, CASE WHEN temporal = 0 OR dated = 1 THEN 1 ELSE 0 END AS temporal_ok FROM flags"),
        ("enough", f"SELECT *, round(least({d.n(1.0)}, turns / {d.n(float(max(3, k / 2)))}) * {d.n(0.45)} + least({d.n(1.0)}, episodes / {d.n(2.0)}) * {d.n(0.20)} + least({d.n(1.0)}, topics / {d.n(1.0)}) * {d.n(0.10)} + temporal_ok * {d.n(0.15)} + lexical_ok * {d.n(0.10)}, 4) AS score FROM supported"),
        ("sufficient", f"SELECT *, CASE WHEN turns < {low} OR temporal_ok = 0 OR lexical_ok = 0 OR score < {d.n(0.66)} THEN 1 ELSE 0 END AS escalate FROM enough")]


def candidates(d: Spark) -> list[Step]:
    """Evidence scores of the memories of each question."""
    both = d.common("f.toks", "q.toks")
    return [*memory_texts(d), ("found_tokens", f"SELECT *, {text.token_set(d, 'content', 1)} AS toks FROM found"),
        ("asked", f"SELECT qid, question, {text.token_set(d, 'question', 1)} AS toks FROM qa"),
        ("evidence", f"""SELECT f.qid, f.layer, f.id, f.toks, {d.n(0.36)} * f.s + {d.n(0.26)} * {both} / greatest(1, {d.size('q.toks')}) + {d.n(0.12)} * CASE f.layer WHEN 'turn' THEN {d.n(1.0)} WHEN 'episode' THEN {d.n(0.82)} ELSE {d.n(0.66)} END
        + CASE WHEN {_signal(d, 'q.question')} AND {_signal(d, 'f.content')} THEN {d.n(0.12)} ELSE {d.n(0.0)} END AS score FROM found_tokens f JOIN asked q ON f.qid = q.qid"""),
        ("evidence_ranked", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, layer, id) AS rnk FROM evidence")]


def again(steps: list[Step], changed: dict[str, str], suffix: str) -> list[Step]:
    """The steps that follow from changed ones, a second time, under names with a suffix. changed: new SQL by name."""
    names, out = {}, []
    first: dict[str, str] = {}
    for name, sql in steps:
        first.setdefault(name, sql)
    for name, sql in first.items():
        if name in changed:
            names[name] = name + suffix
            out.append((name + suffix, changed[name]))
        elif any(re.search(rf"\b(?:FROM|JOIN) {x}\b", sql) for x in names):
            for x, y in names.items():
                sql = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {y}", sql)
            names[name] = name + suffix
            out.append((name + suffix, sql))
    return out


def planned(d: Spark) -> list[Step]:
    """A question's query lists without a model: what the fallbacks of the plan make of its words and names."""
    keywords = tables.keywords(d, "qa_named", "qid", "question")
    return [*tables.queries(d), ("qa_named", f"SELECT qid, sample_id, question, {d.joined(text.entities(d, text.ascii_only(d, 'question')), ' ')} AS names FROM qa"),
        *((f"q_{name}", sql.replace("FROM kw_", "FROM q_kw_")) for name, sql in keywords),
        ("plans", f"SELECT a.qid, a.sample_id, a.question, a.names, {d.joined('k.keywords', ' ')} AS words FROM qa_named a JOIN q_keywords k ON a.qid = k.qid")]


#: What the second and the third pass search for, besides the question.
EXPANDED = ("question", "words", "concat(question, ' ', names)", "concat(question, ' ', names, ' timeline')", "concat(question, ' exact evidence')", "concat(question, ' related background')", "concat(question, ' contradiction latest update')", "concat(question, ' source quote')", "names", "concat(question, ' evidence timeline source')")
VERIFYING = ("concat(question, ' contradiction latest update')", "concat(question, ' source quote')", "question", "concat(question, ' latest update contradiction')", "concat(question, ' direct quote source')")


def searched(d: Spark, queries: tuple[str, ...], asked: str, name: str) -> list[Step]:
    """Each different query of the plans of the questions that are asked again, by its place."""
    every = " UNION ALL ".join(f"SELECT qid, sample_id, {i} AS query_ord, trim({q}) AS query FROM plans" for i, q in enumerate(queries))
    return [(f"{name}_all", f"SELECT x.* FROM ({every}) x JOIN {asked} s ON x.qid = s.qid AND s.escalate = 1 WHERE query <> ''"),
        (name, f"SELECT qid, sample_id, query_ord, query FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(query) ORDER BY query_ord) AS nth FROM {name}_all) y WHERE nth = 1")]


def _better(first: str, second: str, no: int, name: str, d: Spark) -> list[Step]:
    """Both passes' memories by note, with the better score, the earlier pass's if equal, cut to the layers' limits."""
    return [(f"{name}_both", f"SELECT qid, layer, id, s, pass FROM {first} UNION ALL SELECT qid, layer, id, s, {no} FROM {second}"),
        (f"{name}_best", f"SELECT *, row_number() OVER (PARTITION BY qid, layer, id ORDER BY round(s, 9) DESC, pass) AS k FROM {name}_both"),
        (f"{name}_ranked", f"SELECT qid, layer, id, s, pass, row_number() OVER (PARTITION BY qid, layer ORDER BY round(s, 9) DESC, id) AS rnk FROM {name}_best WHERE k = 1"),
        (name, f"SELECT * FROM {name}_ranked WHERE rnk <= CASE layer WHEN 'topic' THEN 1 WHEN 'episode' THEN 3 ELSE 5 END")]


def merged(d: Spark) -> list[Step]:
    """The evidence loop: questions whose memories don't suffice are searched again with all lists of their plans; those that still don't, once more to verify."""
    search, enough = provenance(d), sufficiency(d)
    return [*enough, *planned(d), *searched(d, EXPANDED, "sufficient", "expanded"),
        *again(search, {"queries": "SELECT * FROM expanded"}, "_x"), ("pass1", "SELECT qid, layer, id, s, 1 AS pass FROM memories"), *_better("pass1", "memories_x", 2, "merged_x", d),
        *again(enough, {"memories": "SELECT qid, layer, id, s, rnk FROM merged_x"}, "_m"), *searched(d, VERIFYING, "sufficient_m", "verifying"),
        *again(search, {"queries": "SELECT * FROM verifying"}, "_v"), *_better("merged_x", "memories_v", 3, "merged", d)]
