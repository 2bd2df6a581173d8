"""Retrieval as relational steps: vectors, BM25, recency, fusion, routing, propagation along the hierarchy."""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import Spark
from ..sources import tables

Step = tuple[str, str]
#: Buckets of the hashing embedder.
WIDTH = 256
K1, B, EPSILON = 1.5, 0.75, 0.25
SEMANTIC, LEXICAL, RECENCY, TEMPORAL = 0.68, 0.24, 0.08, 0.10


def hashed(d: Spark, x: str) -> str:
    return f"{d.hex_int(f'substr(md5({x}), 1, 4)')} % {WIDTH}"


def terms(d: Spark) -> list[Step]:
    return [*tables.notes(d), *tables.queries(d),
        ("doc_terms", d.explode("sample_id, ord", text.tokens(d, "doc"), "docs")),
        ("postings", "SELECT sample_id, ord, x AS term, count(*) AS tf FROM doc_terms GROUP BY sample_id, ord, x"),
        ("doc_len", "SELECT sample_id, ord, sum(tf) AS len FROM postings GROUP BY sample_id, ord"),
        ("query_terms", d.explode("qid, query_ord, sample_id", text.token_set(d, "query", 2), "queries"))]


def bm25(d: Spark) -> list[Step]:
    """A row for each query and document that share a term; samples are corpora of their own."""
    return [*terms(d),
        ("corpus", f"SELECT sample_id, count(*) AS n, {d.dbl('sum(len)')} / count(*) AS avg_len FROM doc_len GROUP BY sample_id"),
        ("df", f"SELECT p.sample_id, term, ln(c.n - count(*) + {d.n(0.5)}) - ln(count(*) + {d.n(0.5)}) AS idf FROM postings p JOIN corpus c ON p.sample_id = c.sample_id GROUP BY p.sample_id, term, c.n"),
        ("mean_idf", "SELECT sample_id, avg(idf) AS mean FROM df GROUP BY sample_id"),
        ("weights", f"SELECT f.sample_id, term, CASE WHEN idf < 0 THEN {d.n(EPSILON)} * mean ELSE idf END AS idf FROM df f JOIN mean_idf m ON f.sample_id = m.sample_id"),
        ("bm25", f"""SELECT q.qid, q.query_ord, p.ord, sum(w.idf * (p.tf * {d.n(K1 + 1)}) / (p.tf + {d.n(K1)} * ({d.n(1 - B)} + {d.n(B)} * l.len / c.avg_len))) AS s
        FROM query_terms q JOIN postings p ON q.sample_id = p.sample_id AND q.x = p.term JOIN weights w ON p.sample_id = w.sample_id AND p.term = w.term JOIN doc_len l ON p.ord = l.ord JOIN corpus c ON p.sample_id = c.sample_id
        GROUP BY q.qid, q.query_ord, p.ord""")]  # fmt: skip


def vectors(d: Spark) -> list[Step]:
    """Sparse hashing vectors, joined by bucket inside a sample."""
    q = f"SELECT qid, query_ord, sample_id, {hashed(d, 'x')} AS b, count(*) AS c FROM query_words GROUP BY qid, query_ord, sample_id, {hashed(d, 'x')}"
    return [*terms(d),
        ("doc_vectors", f"SELECT sample_id, ord, {hashed(d, 'term')} AS b, sum(tf) AS c FROM postings GROUP BY sample_id, ord, {hashed(d, 'term')}"),
        ("doc_norms", f"SELECT ord, sqrt({d.dbl('sum(c * c)')}) AS norm FROM doc_vectors GROUP BY ord"),
        ("query_words", d.explode("qid, query_ord, sample_id", text.tokens(d, "query"), "queries")),
        ("query_vectors", q),
        ("query_norms", f"SELECT qid, query_ord, sqrt({d.dbl('sum(c * c)')}) AS norm FROM query_vectors GROUP BY qid, query_ord"),
        ("dots", f"SELECT q.qid, q.query_ord, v.ord, {d.dbl('sum(q.c * v.c)')} AS dot FROM query_vectors q JOIN doc_vectors v ON q.sample_id = v.sample_id AND q.b = v.b GROUP BY q.qid, q.query_ord, v.ord"),
        ("cosine", "SELECT c.qid, c.query_ord, c.ord, dot / (n.norm * m.norm) AS s FROM dots c JOIN doc_norms n ON c.ord = n.ord JOIN query_norms m ON c.qid = m.qid AND c.query_ord = m.query_ord")]


def scaled(x: str, over: str) -> str:
    """Min-max within a partition; all the same gives 0."""
    return f"CASE WHEN max({x}) OVER ({over}) - min({x}) OVER ({over}) > 1e-8 THEN ({x} - min({x}) OVER ({over})) / (max({x}) OVER ({over}) - min({x}) OVER ({over})) ELSE 0 END"


def recency(d: Spark) -> list[Step]:
    return [*tables.notes(d),
        ("stamps", f"SELECT sample_id, ord, CASE WHEN {d.like('ts_raw', '[0-9]')} THEN {d.dbl(f'substr({d.sub("ts_raw", "[^0-9]", "")}, 1, 14)')} ELSE {d.dbl('row_number() OVER (PARTITION BY sample_id ORDER BY ord)')} END AS stamp FROM docs"),
        ("recency", f"SELECT sample_id, ord, {d.dbl(scaled('stamp', 'PARTITION BY sample_id'))} AS rec FROM stamps")]


def temporal(d: Spark) -> list[Step]:
    """How well a question's dates and times stand in a note; a little for notes with others."""
    parts = lambda x: d.uniq(text.temporal_parts(d, text.ascii_only(d, x)))
    return [*tables.notes(d), *tables.queries(d),
        ("dated", f"SELECT qid, query_ord, sample_id, {parts('''CASE WHEN qid % 2 = 0 THEN concat(query, ' 2023') ELSE query END''')} AS t FROM queries"),
        ("note_dates", f"SELECT sample_id, ord, {parts('doc')} AS t FROM docs"),
        ("aligned", f"""SELECT q.qid, q.query_ord, n.ord, CASE WHEN {d.size('q.t')} = 0 OR {d.size('n.t')} = 0 THEN {d.n(0.0)} WHEN {d.common('q.t', 'n.t')} > 0 THEN {d.dbl(d.common('q.t', 'n.t'))} / {d.size('q.t')} ELSE {d.n(0.15)} END AS align
        FROM dated q JOIN note_dates n ON q.sample_id = n.sample_id""")]  # fmt: skip


def fused(d: Spark, sem: str, lex: str, rec: str, extra: list[Step] = (), join: str = "", bonus: str = "") -> list[Step]:
    """All notes of a query's sample with their three scores in [0, 1], the fused score and its rank."""
    over = "PARTITION BY q.qid, q.query_ord"
    return [*bm25(d), *vectors(d), *recency(d), *extra,
        ("parts", f"""SELECT q.qid, q.query_ord, q.sample_id, r.ord, coalesce(c.s, 0) AS raw, {d.dbl(scaled('coalesce(c.s, 0)', over))} AS sem, {d.dbl(scaled('coalesce(b.s, 0)', over))} AS lex, r.rec
        FROM queries q JOIN recency r ON q.sample_id = r.sample_id LEFT JOIN cosine c ON c.qid = q.qid AND c.query_ord = q.query_ord AND c.ord = r.ord LEFT JOIN bm25 b ON b.qid = q.qid AND b.query_ord = q.query_ord AND b.ord = r.ord"""),
        ("mixed", f"SELECT p.*, {sem} * p.sem + {lex} * p.lex + {rec} * p.rec{bonus} AS score FROM parts p {join}"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY qid, query_ord ORDER BY round(score, 9) DESC, ord) AS rnk FROM mixed")]


def static(d: Spark) -> list[Step]:
    return fused(d, d.n(SEMANTIC), d.n(LEXICAL), d.n(RECENCY))


def layers(d: Spark) -> list[Step]:
    """Cosines of every query with the nodes of its sample in all three layers that can be among its eight best ones.

    Episodes and topics have the sums of their turns' vectors. A node without a bucket in common has
    the cosine 0; of those only the first eight of a layer can be needed.
    """
    return [*static(d), *tables.episodes(d),
        ("layer_vectors", """SELECT 'turn' AS layer, sample_id, ord AS id, b, c FROM doc_vectors UNION ALL SELECT 'episode', v.sample_id, p.episode_id, v.b, sum(v.c) FROM doc_vectors v JOIN placed p ON v.ord = p.ord GROUP BY v.sample_id, p.episode_id, v.b
        UNION ALL SELECT 'topic', v.sample_id, p.topic_id, v.b, sum(v.c) FROM doc_vectors v JOIN placed p ON v.ord = p.ord GROUP BY v.sample_id, p.topic_id, v.b"""),
        ("layer_norms", f"SELECT layer, sample_id, id, sqrt({d.dbl('sum(c * c)')}) AS norm FROM layer_vectors GROUP BY layer, sample_id, id"),
        ("layer_dots", f"SELECT v.layer, q.qid, q.query_ord, v.id, {d.dbl('sum(q.c * v.c)')} AS dot FROM query_vectors q JOIN layer_vectors v ON q.sample_id = v.sample_id AND q.b = v.b GROUP BY v.layer, q.qid, q.query_ord, v.id"),
        ("layer_firsts", "SELECT * FROM (SELECT layer, sample_id, id, row_number() OVER (PARTITION BY layer, sample_id ORDER BY id) AS nth FROM layer_norms) x WHERE nth <= 8"),
        ("layer_raw", f"""SELECT layer, qid, query_ord, id, max(raw) AS raw FROM (SELECT c.layer, c.qid, c.query_ord, c.id, c.dot / (n.norm * m.norm) AS raw FROM layer_dots c JOIN layer_norms n ON c.layer = n.layer AND c.id = n.id JOIN query_norms m ON c.qid = m.qid AND c.query_ord = m.query_ord
        UNION ALL SELECT f.layer, q.qid, q.query_ord, f.id, {d.n(0.0)} FROM queries q JOIN layer_firsts f ON q.sample_id = f.sample_id) x GROUP BY layer, qid, query_ord, id""")]  # fmt: skip


def uncertainty(d: Spark) -> list[Step]:
    """Margin, entropy and concentration of a query's eight best cosines in each layer, and what they say together."""
    over = "PARTITION BY layer, qid, query_ord"
    return [*layers(d),
        ("probe", f"SELECT layer, qid, query_ord, id, raw, row_number() OVER ({over} ORDER BY round(raw, 9) DESC, id) AS k FROM layer_raw"),
        ("top8", f"SELECT *, max(raw) OVER ({over}) AS best FROM probe WHERE k <= 8"),
        ("soft", f"SELECT *, exp(greatest({d.n(-30.0)}, least({d.n(30.0)}, (raw - best) / {d.n(0.08)}))) AS e FROM top8"),
        ("shares", f"SELECT *, e / sum(e) OVER ({over}) AS p FROM soft"),
        ("spread", f"""SELECT layer, qid, query_ord, count(*) AS n, CASE WHEN count(*) > 1 THEN least({d.n(1.0)}, greatest({d.n(0.0)}, (max(raw) - max(CASE WHEN k = 2 THEN raw END)) / {d.n(0.08)})) ELSE {d.n(1.0)} END AS margin,
        CASE WHEN count(*) > 1 THEN -sum(p * ln(p + {d.n(1e-12)})) / ln({d.dbl('count(*)')}) ELSE {d.n(0.0)} END AS entropy, max(CASE WHEN k = 1 THEN p END) AS concentration FROM shares GROUP BY layer, qid, query_ord"""),
        ("uncertainty", f"""SELECT layer, qid, query_ord, margin, least({d.n(1.0)}, greatest({d.n(0.0)}, entropy)) AS entropy, concentration,
        least({d.n(1.0)}, greatest({d.n(0.0)}, {d.n(0.45)} * (1 - margin) + {d.n(0.35)} * entropy + {d.n(0.20)} * (1 - concentration))) AS uncertainty FROM spread""")]  # fmt: skip


def agreement(d: Spark) -> list[Step]:
    """Mean Jaccard similarity of the five best nodes of a question's queries in each layer, pair by pair; 1 for a single query."""
    return [*uncertainty(d), ("top5", f"SELECT layer, qid, query_ord, {d.collected('id')} AS ids FROM top8 WHERE k <= 5 GROUP BY layer, qid, query_ord"),
        ("agreement", f"SELECT a.layer, a.qid, coalesce(avg(CASE WHEN b.qid IS NOT NULL THEN {d.dbl(d.common('a.ids', 'b.ids'))} / {d.either('a.ids', 'b.ids')} END), {d.n(1.0)}) AS agreement FROM top5 a LEFT JOIN top5 b ON a.layer = b.layer AND a.qid = b.qid AND a.query_ord < b.query_ord GROUP BY a.layer, a.qid")]


def budget(d: Spark) -> list[Step]:
    """A question's tier, its budget multiplier and its limits, from the uncertainty and disagreement of the three layers."""
    of = lambda layer: f"max(CASE WHEN layer = '{layer}' THEN u END)"
    return [*agreement(d), ("layer_stats", "SELECT u.layer, u.qid, avg(uncertainty) AS u, max(uncertainty) AS max_u, avg(margin) AS margin, avg(entropy) AS entropy, avg(concentration) AS concentration FROM uncertainty u GROUP BY u.layer, u.qid"),
        ("mean_u", f"SELECT qid, {d.n(0.25)} * {of('topic')} + {d.n(0.30)} * {of('episode')} + {d.n(0.45)} * {of('turn')} AS u, max(max_u) AS max_u, {of('turn')} - {d.n(0.5)} * ({of('topic')} + {of('episode')}) AS gap FROM layer_stats GROUP BY qid"),
        ("agreed", "SELECT qid, avg(agreement) AS agreement FROM agreement GROUP BY qid"),
        ("routed", f"SELECT m.*, a.agreement, least({d.n(1.0)}, greatest({d.n(0.0)}, {d.n(0.8)} * u + {d.n(0.2)} * (1 - a.agreement))) AS routing FROM mean_u m JOIN agreed a ON m.qid = a.qid"),
        ("tiers", f"SELECT *, CASE WHEN round(routing, 9) < {d.n(0.4)} THEN 'low' WHEN round(routing, 9) >= {d.n(0.7)} THEN 'high' ELSE 'mid' END AS tier FROM routed"),
        ("budget", f"""SELECT *, CASE tier WHEN 'low' THEN {d.n(0.8)} WHEN 'high' THEN {d.n(1.55)} ELSE {d.n(1.0)} END AS mult, CASE tier WHEN 'low' THEN {d.n(0.0)} WHEN 'high' THEN {d.n(1.0)} ELSE {d.n(0.5)} END AS complexity FROM tiers"""),
        ("limits", f"""SELECT *, {d.long(f'ceil(round(1 * mult, 9))')} AS topics, {d.long('ceil(round(3 * mult, 9))')} AS episodes, {d.long('ceil(round(5 * mult, 9))')} AS turns,
        {d.long('ceil(round((1 + 1) * mult, 9))')} AS cand_topics, {d.long('ceil(round((3 + 2) * mult, 9))')} AS cand_episodes, {d.long('ceil(round((5 + 5) * mult, 9))')} AS cand_turns FROM budget"""),
        ("limits2", f"SELECT *, greatest(cand_turns, {d.long(d.half_even(f'greatest({d.n(0.25)}, mult) * cand_turns'))}) AS kept_turns FROM limits")]


def fusion_weights(d: Spark) -> list[Step]:
    """Weights of the three scores that follow a question's complexity, disagreement, uncertainty and turn focus part of the way."""
    t = "CASE WHEN qid % 2 = 0 THEN 1 ELSE 0 END"
    floor = lambda x: f"greatest({x}, {d.n(0.01)})"
    focus = f"least({d.n(1.0)}, greatest({d.n(0.0)}, gap) / {d.n(0.30)})"
    return [*budget(d), ("shifts", f"SELECT qid, {d.n(0.12)} * complexity + {d.n(0.10)} * (1 - agreement) + {d.n(0.06)} * u - {d.n(0.08)} * {t} AS s1, {d.n(-0.04)} * complexity + {d.n(0.07)} * agreement + {d.n(0.04)} * {t} AS s2, {d.n(-0.03)} * complexity + {d.n(0.04)} * u + {d.n(0.14)} * {t} + {d.n(0.10)} * {focus} AS s3 FROM budget"),
        ("aims", f"SELECT qid, {floor(f'{d.n(SEMANTIC)} + s1')} AS a1, {floor(f'{d.n(LEXICAL)} + s2')} AS a2, {floor(f'{d.n(RECENCY)} + s3')} AS a3 FROM shifts"),
        ("blended", f"SELECT qid, {floor(f'{d.n(0.65)} * {d.n(SEMANTIC)} + {d.n(0.35)} * a1 / (a1 + a2 + a3)')} AS b1, {floor(f'{d.n(0.65)} * {d.n(LEXICAL)} + {d.n(0.35)} * a2 / (a1 + a2 + a3)')} AS b2, {floor(f'{d.n(0.65)} * {d.n(RECENCY)} + {d.n(0.35)} * a3 / (a1 + a2 + a3)')} AS b3 FROM aims"),
        ("fusion", "SELECT qid, b1 / (b1 + b2 + b3) AS w1, b2 / (b1 + b2 + b3) AS w2, b3 / (b1 + b2 + b3) AS w3 FROM blended")]


def propagated(d: Spark) -> list[Step]:
    """Scores of the hits of a question's queries, and what they hand to episodes and topics, summed."""
    hit = f"score + {d.n(0.01)} / rnk"
    return [*static(d), *tables.episodes(d),
        ("hits", f"SELECT qid, query_ord, 'turn' AS layer, r.ord AS id, {hit} AS s, p.episode_id, p.topic_id FROM ranked r JOIN placed p ON r.ord = p.ord WHERE rnk <= 10"),
        ("episode_scores", f"SELECT r.qid, r.query_ord, p.episode_id, p.topic_id, max(r.score) AS score FROM ranked r JOIN placed p ON r.ord = p.ord GROUP BY r.qid, r.query_ord, p.episode_id, p.topic_id"),
        ("episode_ranked", "SELECT *, row_number() OVER (PARTITION BY qid, query_ord ORDER BY round(score, 9) DESC, episode_id) AS rnk FROM episode_scores"),
        ("episode_hits", f"SELECT qid, query_ord, episode_id, topic_id, {hit} AS s FROM episode_ranked WHERE rnk <= 5"),
        ("topic_scores", "SELECT qid, query_ord, topic_id, max(score) AS score FROM episode_scores GROUP BY qid, query_ord, topic_id"),
        ("topic_ranked", "SELECT *, row_number() OVER (PARTITION BY qid, query_ord ORDER BY round(score, 9) DESC, topic_id) AS rnk FROM topic_scores"),
        ("topic_hits", f"SELECT qid, query_ord, topic_id, {hit} AS s FROM topic_ranked WHERE rnk <= 2"),
        ("given", f"""SELECT qid, 'turn' AS layer, id, s FROM hits UNION ALL SELECT qid, 'episode', episode_id, s FROM episode_hits UNION ALL SELECT qid, 'topic', topic_id, s FROM topic_hits
        UNION ALL SELECT h.qid, 'episode', e.episode_id, h.s * {d.n(0.60)} FROM topic_hits h JOIN episodes e ON h.topic_id = e.topic_id
        UNION ALL SELECT qid, 'topic', topic_id, s * {d.n(0.20)} FROM episode_hits
        UNION ALL SELECT h.qid, 'turn', p.ord, h.s * {d.n(0.50)} / (p.pos + 1) FROM episode_hits h JOIN placed p ON h.episode_id = p.episode_id
        UNION ALL SELECT qid, 'episode', episode_id, s * {d.n(0.30)} FROM hits UNION ALL SELECT qid, 'topic', topic_id, s * {d.n(0.12)} FROM hits"""),
        ("summed", "SELECT qid, layer, id, sum(s) AS s FROM given GROUP BY qid, layer, id")]


def provenance(d: Spark) -> list[Step]:
    """The best topics lift their episodes; episodes with fewer than two scored turns lift their first ones."""
    return [*propagated(d),
        ("topic_best", "SELECT qid, id AS topic_id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS k FROM summed WHERE layer = 'topic'"),
        ("lifted", f"SELECT t.qid, e.episode_id AS id, t.s * {d.n(0.60)} * {d.n(0.55)} / (e.pos + 1) AS s FROM topic_best t JOIN episodes e ON t.topic_id = e.topic_id WHERE k <= 5"),
        ("episode_sums", "SELECT qid, id, sum(s) AS s FROM (SELECT qid, id, s FROM summed WHERE layer = 'episode' UNION ALL SELECT qid, id, s FROM lifted) x GROUP BY qid, id"),
        ("episode_best", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS k FROM episode_sums"),
        ("children", "SELECT e.qid, e.id AS episode_id, e.s AS es, p.ord, p.pos, coalesce(u.s, 0) AS ts FROM episode_best e JOIN placed p ON e.id = p.episode_id LEFT JOIN summed u ON u.qid = e.qid AND u.layer = 'turn' AND u.id = p.ord WHERE e.k <= 10"),
        ("backed", "SELECT *, sum(CASE WHEN ts > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, episode_id) AS support FROM children"),
        ("turn_lift", f"SELECT qid, ord AS id, es * {d.n(0.50)} * {d.n(0.55)} / (pos + 1) AS s FROM backed WHERE support < 2 AND pos < greatest(4 * (2 - support), 2 - support)"),
        ("boosted", "SELECT qid, layer, id, sum(s) AS s FROM (SELECT qid, layer, id, s FROM summed UNION ALL SELECT qid, 'episode', id, s FROM lifted UNION ALL SELECT qid, 'turn', id, s FROM turn_lift) x GROUP BY qid, layer, id"),
        ("final_ranked", "SELECT *, row_number() OVER (PARTITION BY qid, layer ORDER BY round(s, 9) DESC, id) AS rnk FROM boosted"),
        ("memories", "SELECT * FROM final_ranked WHERE rnk <= CASE layer WHEN 'topic' THEN 1 WHEN 'episode' THEN 3 ELSE 5 END")]
