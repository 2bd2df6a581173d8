"""Named plans over the input tables; each is a function of the dialect."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text
from ..operators import evaluation as ev
from ..operators import evidence as evi
from ..operators import retrieval as ret
from ..sources import tables
from .dialect import Duck, Spark, plan, with_steps

Plan = Callable[[Spark], str]
PLANS: dict[str, Plan] = {}
#: Steps that several later ones read: they are written once, to the folder that all executors share.
SHARED = ("docs", "postings", "parts", "ranked", "placed", "episodes", "summed", "boosted", "memories", "found", "top8", "budget", "limits2", "ev", "metrics", "votes", "layer_raw", "merged_x", "sufficient")
TABLES = ("conversations", "benchmark", "documents", "labels", "events", "embeddings")


def named(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


def _written(df: DataFrame, name: str) -> DataFrame:
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/palimpsest-steps/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The plan over the Parquet tables of a directory."""
    prefix = f"palimpsest_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}_"
    sql = PLANS[name](Spark(prefix))
    for t in TABLES:
        if prefix + t in sql:
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(prefix + t)
    steps, used = dict(sql.steps), sql
    for i, step in enumerate(steps):
        later = " ".join([*list(steps.values())[i + 1 :], sql.final])
        if re.sub("_[xmv]$", "", step) in SHARED and len(re.findall(rf"\b{step}\b", later)) > 1:
            before = dict(list(steps.items())[: i + 1])
            view = f"{prefix}{step}_{uuid.uuid4().hex[:8]}"
            _written(spark.sql(with_steps(before, f"SELECT * FROM {step}")), view).createOrReplaceTempView(view)
            steps[step] = f"SELECT * FROM {view}"
            used = with_steps(steps, sql.final)
    return spark.sql(used)


def oracle(name: str) -> str:
    return PLANS[name](Duck())


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


@named
def turn_tokens(d: Spark) -> str:
    return plan(*tables.turns(d), final=f"SELECT ord, {d.joined(text.tokens(d, 'content'), ' ')} AS tokens FROM turns")


@named
def token_set_len3(d: Spark) -> str:
    return plan(*tables.turns(d), final=f"SELECT ord, {d.joined(text.token_set(d, 'content', 2), ' ')} AS tokens FROM turns")


@named
def token_set_len2(d: Spark) -> str:
    return plan(*tables.turns(d), final=f"SELECT ord, {d.joined(text.token_set(d, 'content', 1), ' ')} AS tokens FROM turns")


@named
def unique_preserve_order(d: Spark) -> str:
    return plan(*tables.turns(d), ("t", f"SELECT ord, {text.tokens(d, 'content')} AS a FROM turns"), final=f"SELECT ord, {d.joined(text.ordered_distinct(d, 'a'), ' ')} AS tokens FROM t")


@named
def squeezed_text(d: Spark) -> str:
    return plan(final=f"SELECT doc_id, md5({text.squeezed(d, 'text')}) AS normalized FROM {d.table('documents')}")


@named
def temporal_tokens(d: Spark) -> str:
    return plan(("t", f"SELECT doc_id, {text.temporal_parts(d, text.ascii_only(d, 'text'))} AS a FROM {d.table('documents')}"), final=f"SELECT doc_id, {d.joined(text.ordered_distinct(d, 'a'), ' ')} AS tokens FROM t")


@named
def integer_list(d: Spark) -> str:
    return plan(final=f"SELECT event_id, {d.joined(d.each(d.found('props', '[0-9]+'), 'CAST(CAST(v AS BIGINT) AS VARCHAR(20))' if d.name == 'duckdb' else 'CAST(CAST(v AS BIGINT) AS STRING)'), ',')} AS ints FROM {d.table('events')}")


@named
def anchor_terms(d: Spark) -> str:
    """Years, dates, times, capitalised words and numbers, each once, sixteen at most."""
    x = text.ascii_only(d, "text")
    parts = d.cat(*(d.found(x, p) for p in (text.YEAR, text.DATE, text.CLOCK, r"\b[A-Z][a-zA-Z]{2,}\b")), d.found(f"lower({x})", r"\b\d+(?:st|nd|rd|th)?\b"))
    return plan(("t", f"SELECT doc_id, {parts} AS a FROM {d.table('documents')}"), ("l", f"SELECT doc_id, a, {d.each('a', 'lower(v)')} AS b FROM t"),
        final=f"SELECT doc_id, {d.joined(d.cut(d.keep('a', f'{d.at(chr(98), "lower(v)")} = @i'), 16), '|')} AS terms FROM l")


@named
def merged_anchors(d: Spark) -> str:
    """A session's anchors: its turns' ones in order, each once, twenty-four at most."""
    x = text.ascii_only(d, "text")
    return plan(*tables.turns(d), ("t", d.explode("session_id, turn_idx", d.found(x, r"\b[A-Z][a-z]+\b"), "turns")),
        ("f", f"SELECT session_id, x, min(turn_idx * {tables.WIDE} + pos) AS place FROM t GROUP BY session_id, x"), ("k", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS nth FROM f"),
        final=f"SELECT session_id, {d.listed('x', '|', 'nth')} AS anchors, count(*) AS n FROM k WHERE nth <= 24 GROUP BY session_id")


@named
def heuristic_keywords(d: Spark) -> str:
    return plan(*tables.turns(d), *tables.keywords(d), final=f"SELECT ord, {d.joined('keywords', ',')} AS keywords FROM keywords")


@named
def heuristic_context(d: Spark) -> str:
    return plan(*tables.turns(d), final=f"SELECT ord, {text.first_sentence(d, 'content')} AS context FROM turns")


@named
def token_estimate(d: Spark) -> str:
    return plan(final=f"SELECT doc_id, {text.estimate(d, 'text')} AS tokens FROM {d.table('documents')}")


@named
def jaccard_variants(d: Spark) -> str:
    """Overlap of neighbouring turns' token sets: empty sets count as equal, or as nothing in common."""
    return plan(*tables.turns(d), ("s", f"SELECT session_id, turn_idx, ord, {text.token_set(d, 'text', 2)} AS a FROM turns"), ("p", f"SELECT x.ord, {d.common('x.a', 'y.a')} AS m, {d.either('x.a', 'y.a')} AS n FROM s x JOIN s y ON x.session_id = y.session_id AND y.turn_idx = x.turn_idx + 1"),
        final=f"SELECT ord, {_r(f'CASE WHEN n = 0 THEN {d.n(1.0)} ELSE {d.dbl("m")} / n END', 'set_jaccard')}, {_r(f'CASE WHEN n = 0 OR m = 0 THEN {d.n(0.0)} ELSE {d.dbl("m")} / n END', 'lexical_overlap')} FROM p")


@named
def head_ratio(d: Spark) -> str:
    return plan(("n", f"SELECT greatest(1, {d.long(f'floor(count(*) * {d.n(0.25)})')}) AS keep FROM {d.table('benchmark')}"), ("o", f"SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ord FROM {d.table('benchmark')}"),
        final="SELECT item_id, ord FROM o CROSS JOIN n WHERE ord < keep")


@named
def abstention_flag(d: Spark) -> str:
    return plan(("q", f"SELECT doc_id, concat('q', doc_id, CASE WHEN toxic = 1 THEN '_abs' ELSE '' END) AS qid FROM {d.table('labels')}"), final=f"SELECT qid, {'ends_with' if d.name == 'duckdb' else 'endswith'}(qid, '_abs') AS abstention FROM q")


@named
def category_filter(d: Spark) -> str:
    return plan(*ev.judged(d), final="SELECT doc_id, category FROM judged WHERE category IN (1, 2, 3, 4)")


@named
def loader_stats(d: Spark) -> str:
    return plan(*tables.turns(d), ("n", "SELECT session_id, count(*) AS k FROM turns GROUP BY session_id"), final=f"SELECT count(*) AS sessions, {d.long('sum(k)')} AS turns, {_r('avg(k)', 'mean')}, min(k) AS least, max(k) AS most FROM n")


@named
def session_groups(d: Spark) -> str:
    return plan(*tables.turns(d), final=f"SELECT session_id, {d.listed('dia_id', ',', 'turn_idx')} AS dia_ids, count(*) AS n FROM turns GROUP BY session_id")


@named
def turn_documents(d: Spark) -> str:
    return plan(*tables.notes(d), final="SELECT ord, doc FROM docs")


@named
def session_segments(d: Spark) -> str:
    return plan(*tables.episodes(d), final=f"SELECT session_id, {d.long('segment')} AS segment, min(turn_idx) AS first_turn, max(turn_idx) AS last_turn, count(*) AS n FROM placed GROUP BY session_id, segment")


@named
def evenly_spaced_turns(d: Spark) -> str:
    """Eight turns of each sample, evenly spaced, the last one included."""
    place = f"CASE WHEN v = 7 THEN n - 1 ELSE {d.long(f'floor(v * ({d.dbl("n - 1")} / 7))')} END"
    return plan(*tables.turns(d), ("o", "SELECT sample_id, ord, row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM turns"),
        ("w", f"SELECT *, {d.each(d.spread('8'), place)} AS want FROM o"), final=f"SELECT sample_id, ord FROM w WHERE n <= 8 OR {d.has('want', 'k')}")


@named
def recent_window(d: Spark) -> str:
    return plan(*tables.turns(d), ("o", "SELECT sample_id, ord, row_number() OVER (PARTITION BY sample_id ORDER BY ord DESC) AS k FROM turns"), final="SELECT sample_id, ord FROM o WHERE k <= 24")


@named
def episode_fallback_summary(d: Spark) -> str:
    return plan(*evi.episode_texts(d), final=f"SELECT {d.long('episode_id')} AS episode_id, summary FROM episode_texts")


@named
def episode_titles(d: Spark) -> str:
    return plan(*evi.episode_texts(d), final=f"SELECT {d.long('episode_id')} AS episode_id, title FROM episode_titled")


@named
def topic_rollup(d: Spark) -> str:
    """A topic's episodes in order, and the time stamp of its last one."""
    return plan(*tables.episodes(d), final=f"SELECT topic_id, count(*) AS n, max(ts_raw) AS ts_raw, {d.listed('CAST(' + d.long('episode_id') + ' AS VARCHAR(20))' if d.name == 'duckdb' else 'CAST(' + d.long('episode_id') + ' AS STRING)', ',', 'episode_id')} AS episodes FROM episodes GROUP BY topic_id")


def _episode_vectors(d: Spark) -> list[tuple[str, str]]:
    return [*ret.vectors(d), *tables.episodes(d), ("ev", "SELECT p.sample_id, p.topic_id, p.episode_id, v.b, sum(v.c) AS c FROM doc_vectors v JOIN placed p ON v.ord = p.ord GROUP BY p.sample_id, p.topic_id, p.episode_id, v.b"),
        ("en", f"SELECT episode_id, sqrt({d.dbl('sum(c * c)')}) AS norm FROM ev GROUP BY episode_id")]


@named
def episode_distance(d: Spark) -> str:
    return plan(*_episode_vectors(d), ("dt", f"SELECT x.episode_id AS a, y.episode_id AS b, {d.dbl('sum(x.c * y.c)')} AS dot FROM ev x JOIN ev y ON x.sample_id = y.sample_id AND x.b = y.b AND x.episode_id < y.episode_id GROUP BY x.episode_id, y.episode_id"),
        final=f"SELECT {d.long('a')} AS a, {d.long('dt.b')} AS b, {_r('1 - dot / (n.norm * m.norm)', 'distance')} FROM dt JOIN en n ON dt.a = n.episode_id JOIN en m ON dt.b = m.episode_id")


@named
def best_topic_match(d: Spark) -> str:
    """The topic that an episode fits best, by cosine and words in common, if it has one of them and fits well enough."""
    words = f"SELECT p.{{0}}, {d.uniq(d.flat(d.gathered(text.token_set(d, 't.doc', 2))))} AS w FROM docs t JOIN placed p ON t.ord = p.ord GROUP BY p.{{0}}"
    return plan(*_episode_vectors(d), ("tv", "SELECT sample_id, topic_id, b, sum(c) AS c FROM ev GROUP BY sample_id, topic_id, b"), ("tn", f"SELECT topic_id, sqrt({d.dbl('sum(c * c)')}) AS norm FROM tv GROUP BY topic_id"),
        ("ew", words.format("episode_id")), ("tw", words.format("topic_id")),
        ("dt", f"SELECT x.episode_id, y.topic_id, {d.dbl('sum(x.c * y.c)')} AS dot FROM ev x JOIN tv y ON x.sample_id = y.sample_id AND x.b = y.b GROUP BY x.episode_id, y.topic_id"),
        ("sc", f"SELECT dt.episode_id, dt.topic_id, dot / (n.norm * m.norm) AS cosine, {d.common('e.w', 't.w')} AS overlap, {d.either('e.w', 't.w')} AS of_all FROM dt JOIN en n ON dt.episode_id = n.episode_id JOIN tn m ON dt.topic_id = m.topic_id JOIN ew e ON dt.episode_id = e.episode_id JOIN tw t ON dt.topic_id = t.topic_id"),
        ("sf", f"SELECT *, cosine + {d.n(0.03)} * overlap + {d.n(0.08)} * overlap / greatest(1, of_all) AS s FROM sc WHERE overlap >= 1"),
        ("rk", "SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY round(s, 9) DESC, topic_id) AS k FROM sf"),
        final=f"SELECT {d.long('episode_id')} AS episode_id, topic_id, {_r('s', 'score')}, overlap FROM rk WHERE k = 1 AND s >= {d.n(0.62)}")


@named
def topic_membership_check(d: Spark) -> str:
    """Episodes that neither the topics' lists nor the hits refer to."""
    return plan(*tables.episodes(d), ("refs", "SELECT episode_id FROM episodes WHERE pos < 2 UNION SELECT episode_id FROM episodes WHERE segment = 0"),
        final=f"SELECT {d.long('e.episode_id')} AS episode_id FROM episodes e {'ANTI JOIN' if d.name == 'duckdb' else 'LEFT ANTI JOIN'} refs r ON e.episode_id = r.episode_id")


@named
def bm25_topk(d: Spark) -> str:
    return plan(*ret.bm25(d), ("k", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, ord) AS rnk FROM bm25 WHERE query_ord = 0"), final=f"SELECT qid, ord, {_r('s', 'score')}, rnk FROM k WHERE rnk <= 5")


@named
def cosine_topk(d: Spark) -> str:
    """The eight vectors closest to each vector whose id 10 divides."""
    dot = lambda a, b: d.fold(f"zip_with({a}, {b}, (x, y) -> struct(x AS x, y AS y))", "CAST(v.x AS DOUBLE) * v.y") if d.name == "spark" else f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    return plan(("v", f"SELECT vec_id, embedding, sqrt({dot('embedding', 'embedding')}) AS norm FROM {d.table('embeddings')}"), ("s", f"SELECT a.vec_id AS qid, b.vec_id, CASE WHEN a.norm * b.norm > 0 THEN {dot('a.embedding', 'b.embedding')} / (a.norm * b.norm) ELSE 0 END AS s FROM v a JOIN v b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id"),
        ("k", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS rnk FROM s"), final=f"SELECT qid, vec_id, {_r('s', 'cosine')}, rnk FROM k WHERE rnk <= 8")


@named
def recency_norm(d: Spark) -> str:
    return plan(*ret.recency(d), final=f"SELECT ord, {_r('rec', 'recency')} FROM recency")


@named
def temporal_alignment(d: Spark) -> str:
    return plan(*ret.temporal(d), final=f"SELECT qid, ord, {_r('align', 'align')} FROM aligned WHERE query_ord = 0")


@named
def hybrid_topk_static(d: Spark) -> str:
    return plan(*ret.static(d), final=f"SELECT qid, ord, {_r(f'score + {d.n(0.01)} / rnk', 'score')}, {_r('sem', 'semantic')}, {_r('lex', 'lexical')}, {_r('rec', 'recency')}, rnk FROM ranked WHERE query_ord = 0 AND rnk <= 5")


@named
def score_uncertainty(d: Spark) -> str:
    return plan(*ret.uncertainty(d), final=f"SELECT layer, qid, query_ord, {_r('margin', 'margin')}, {_r('entropy', 'entropy')}, {_r('concentration', 'concentration')}, {_r('uncertainty', 'uncertainty')} FROM uncertainty")


@named
def query_agreement(d: Spark) -> str:
    return plan(*ret.agreement(d), final=f"SELECT layer, qid, {_r('agreement', 'agreement')} FROM agreement")


@named
def budget_profile(d: Spark) -> str:
    return plan(*ret.budget(d), final=f"SELECT qid, {_r('u', 'mean_uncertainty')}, {_r('max_u', 'max_uncertainty')}, {_r('gap', 'turn_focus')}, {_r('agreement', 'agreement')}, {_r('routing', 'routing')}, tier, mult FROM budget")


@named
def layer_statistics(d: Spark) -> str:
    """Means and the maximum of a question's uncertainty in each layer."""
    return plan(*ret.budget(d), final=f"SELECT layer, qid, {_r('u', 'uncertainty')}, {_r('max_u', 'max_uncertainty')}, {_r('margin', 'margin')}, {_r('entropy', 'entropy')}, {_r('concentration', 'concentration')} FROM layer_stats")


@named
def routing_record(d: Spark) -> str:
    """What a question's routing has decided, beside the fixed profile that holds without routing."""
    return plan(*ret.budget(d), final=f"SELECT qid, tier, mult, {_r('routing', 'routing')}, topics, episodes, turns, cand_topics, cand_episodes, kept_turns, 'fixed' AS fixed_tier, {d.n(1.0)} AS fixed_mult, {d.long('1')} AS fixed_topics, {d.long('3')} AS fixed_episodes, {d.long('5')} AS fixed_turns FROM limits2")


@named
def query_plan(d: Spark) -> str:
    """The query lists of a question that need no model."""
    lists = " UNION ALL ".join(f"SELECT qid, {i} AS place, '{kind}' AS kind, trim({q}) AS query FROM plans" for i, (kind, q) in enumerate([*(("search", q) for q in evi.EXPANDED), *(("verify", q) for q in evi.VERIFYING)]))
    return plan(*evi.planned(d), final=f"SELECT qid, kind, place, query FROM ({lists}) x WHERE query <> ''")


@named
def candidate_limits(d: Spark) -> str:
    return plan(*ret.budget(d), final="SELECT qid, tier, topics, episodes, turns, cand_topics, cand_episodes, cand_turns, kept_turns FROM limits2")


@named
def final_limits(d: Spark) -> str:
    """Limits under a cap of seven items: the largest gives way, turns before episodes before topics."""
    return plan(*ret.budget(d), ("over", "SELECT qid, topics, episodes, turns, greatest(0, topics + episodes + turns - 7) AS excess FROM limits2"),
        ("less", "SELECT *, least(excess, greatest(0, turns - episodes)) AS first_cut FROM over"), ("rest", "SELECT *, turns - first_cut AS t1, excess - first_cut AS e1 FROM less"),
        final=f"SELECT qid, topics, {d.long('episodes - ' + d.div('e1', '2'))} AS episodes, {d.long('t1 - ' + d.div('(e1 + 1)', '2'))} AS turns FROM rest")


@named
def fusion_weights(d: Spark) -> str:
    return plan(*ret.fusion_weights(d), final=f"SELECT qid, {_r('w1', 'semantic')}, {_r('w2', 'lexical')}, {_r('w3', 'recency')} FROM fusion")


@named
def hybrid_topk_adaptive(d: Spark) -> str:
    """Fusion weights and limits by question, and the bonus for dates where a question has any."""
    return plan(*ret.fusion_weights(d), *ret.temporal(d),
        ("mixed2", f"SELECT p.*, f.w1 * p.sem + f.w2 * p.lex + f.w3 * p.rec + CASE WHEN p.qid % 2 = 0 THEN {d.n(ret.TEMPORAL)} * coalesce(a.align, 0) ELSE 0 END AS score FROM parts p JOIN fusion f ON p.qid = f.qid LEFT JOIN aligned a ON a.qid = p.qid AND a.query_ord = p.query_ord AND a.ord = p.ord WHERE p.query_ord = 0"),
        ("ranked2", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord) AS rnk FROM mixed2"),
        final=f"SELECT r.qid, r.ord, {_r(f'r.score + {d.n(0.01)} / r.rnk', 'score')}, r.rnk FROM ranked2 r JOIN limits2 l ON r.qid = l.qid WHERE r.rnk <= l.turns")


@named
def edge_propagation(d: Spark) -> str:
    return plan(*ret.propagated(d), final=f"SELECT qid, layer, {d.long('id')} AS id, {_r('s', 'score')} FROM summed")


@named
def provenance_boost(d: Spark) -> str:
    return plan(*ret.provenance(d), final=f"SELECT qid, layer, {d.long('id')} AS id, {_r('s', 'score')} FROM boosted")


@named
def ranked_memories(d: Spark) -> str:
    return plan(*ret.provenance(d), final=f"SELECT qid, layer, {d.long('id')} AS id, concat(CASE layer WHEN 'topic' THEN 'T' WHEN 'episode' THEN 'E' ELSE 'R' END, lpad(CAST(rnk AS {'VARCHAR' if d.name == 'duckdb' else 'STRING'}), 3, '0')) AS place, {_r('s', 'score')}, rnk FROM memories")


@named
def sufficiency(d: Spark) -> str:
    return plan(*evi.sufficiency(d), final=f"SELECT qid, {d.long('turns')} AS turns, {d.long('episodes')} AS episodes, {d.long('topics')} AS topics, temporal, temporal_ok, score, escalate FROM sufficient")


@named
def escalated_merge(d: Spark) -> str:
    return plan(*evi.merged(d), final=f"SELECT qid, layer, {d.long('id')} AS id, pass, {_r('s', 'score')}, rnk FROM merged")


@named
def evidence_scores(d: Spark) -> str:
    return plan(*evi.candidates(d), final=f"SELECT qid, layer, {d.long('id')} AS id, {_r('score', 'score')}, rnk FROM evidence_ranked")


@named
def render_context(d: Spark) -> str:
    """A question's memories as text blocks, and their speakers."""
    return plan(*evi.memory_texts(d), ("b", f"SELECT qid, layer, rnk, concat('[', layer, ' ', rnk, '] ', {d.sub('content', '[ \\t\\n]+', ' ')}) AS block FROM found"), ("l", "SELECT *, CASE layer WHEN 'topic' THEN 0 WHEN 'episode' THEN 10 ELSE 20 END + rnk AS place FROM b"),
        final=f"SELECT qid, {d.listed('block', '; ', 'place')} AS context, count(*) AS n FROM l GROUP BY qid")


@named
def exact_match_f1(d: Spark) -> str:
    return plan(*ev.metrics(d), final=f"SELECT pair_id, em, {_r('f1', 'f1')} FROM metrics")


@named
def rouge12_bleu1(d: Spark) -> str:
    return plan(*ev.metrics(d), final=f"SELECT pair_id, {_r('rouge1', 'rouge1')}, {_r('rouge2', 'rouge2')}, {_r('bleu1', 'bleu1')} FROM metrics")


@named
def metric_aggregates(d: Spark) -> str:
    return plan(*ev.long_metrics(d), final=f"SELECT metric, kind, count(*) AS n, {_r('avg(v)', 'mean')}, {_r(f'coalesce(stddev_samp(v), {d.n(0.0)})', 'std')}, {_r('median(v)', 'median')}, {_r('min(v)', 'least')}, {_r('max(v)', 'most')} FROM long_metrics GROUP BY GROUPING SETS ((metric), (metric, kind))")


@named
def judge_majority(d: Spark) -> str:
    return plan(*ev.judged(d), final="SELECT doc_id, label FROM votes")


@named
def judge_accuracy(d: Spark) -> str:
    return plan(*ev.judged(d), final=f"SELECT category, count(*) AS n, {_r('avg(label)', 'accuracy')} FROM votes GROUP BY ROLLUP (category)")


@named
def question_type_accuracy(d: Spark) -> str:
    """Accuracy of each of the six types (null where a type is absent), over all answers, over the types, and of abstentions."""
    return plan(*ev.judged(d), ("by_type", "SELECT t.question_type, avg(v.label) AS acc, count(v.label) AS n FROM question_types t LEFT JOIN votes v ON t.question_type = v.question_type GROUP BY t.question_type"),
        final="SELECT question_type AS bucket, round(acc, 4) AS accuracy, n FROM by_type UNION ALL SELECT 'micro', round(avg(label), 4), count(*) FROM votes UNION ALL SELECT 'macro', round(avg(acc), 4), count(acc) FROM by_type UNION ALL SELECT 'abstention', round(avg(label), 4), count(*) FROM votes WHERE abstention = 1")


@named
def per_type_text_metrics(d: Spark) -> str:
    """Means in all buckets that an answer belongs to: its type, abstention, overall."""
    buckets = d.keep(d.array("concat('type:', question_type)", "CASE WHEN abstention = 1 THEN 'abstention' ELSE '' END", "'overall'"), "v <> ''")
    return plan(*ev.judged(d), ("m", d.explode("doc_id, length(text) AS size, label", buckets, "votes")), final=f"SELECT x AS bucket, count(*) AS n, {_r('avg(size)', 'mean_size')}, {_r('avg(label)', 'mean_label')} FROM m GROUP BY x")


@named
def routing_summary(d: Spark) -> str:
    return plan(*ret.budget(d), final=f"SELECT tier, count(*) AS n, {_r(d.dbl('sum(CASE WHEN qid % 2 = 0 THEN 1 ELSE 0 END)') + ' / count(*)', 'temporal_rate')}, {_r('avg(turns)', 'mean_turns')} FROM limits2 GROUP BY tier")


@named
def answer_lengths(d: Spark) -> str:
    return plan(*ev.pairs(d), final=f"SELECT kind, {d.long('sum(length(trim(pred)))')} AS pred_total, {_r('avg(length(trim(pred)))', 'pred_mean')}, {d.long('sum(length(trim(ref)))')} AS ref_total, {_r(f'CASE WHEN sum(length(trim(ref))) = 0 THEN NULL ELSE {d.dbl("sum(length(trim(pred)))")} / sum(length(trim(ref))) END', 'ratio')} FROM pairs GROUP BY kind")


@named
def last_result_wins(d: Spark) -> str:
    return plan(("s", f"SELECT doc_id % 97 AS qid, doc_id AS pos, source FROM {d.table('documents')}"), ("k", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos DESC) AS nth FROM s"), final="SELECT qid, pos, source FROM k WHERE nth = 1")


@named
def plan_alignment(d: Spark) -> str:
    """Stored plans by question; by position where a question has none. Counts what disagrees."""
    return plan(*tables.questions(d), ("q", "SELECT qid, question, row_number() OVER (ORDER BY qid) AS pos FROM qa"), ("p", "SELECT qid, pos, concat('plan ', qid) AS stored FROM q WHERE qid % 7 <> 0"), ("r", "SELECT pos, concat('plan at ', pos) AS stored FROM q"),
        final="SELECT q.qid, coalesce(p.stored, r.stored) AS stored, CASE WHEN p.qid IS NULL THEN 1 ELSE 0 END AS by_position FROM q LEFT JOIN p ON q.qid = p.qid LEFT JOIN r ON q.pos = r.pos")


@named
def evidence_suffix_join(d: Spark) -> str:
    """Evidence names turns by the end of their ids, within a session."""
    ends = "ends_with" if d.name == "duckdb" else "endswith"
    return plan(*tables.turns(d), ("e", f"SELECT session_id, turn_idx, concat('D:', turn_idx + 1) AS evidence FROM turns WHERE turn_idx % 3 = 0"), ("s", f"SELECT *, {d.first('evidence', '^[^:]*:([^:]*)')} AS tail FROM e"),
        final=f"SELECT t.dia_id, s.evidence FROM s JOIN turns t ON s.session_id = t.session_id AND {ends}(t.dia_id, s.tail)")


