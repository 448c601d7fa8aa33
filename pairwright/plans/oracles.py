"""The catalogue's queries in SQL for DuckDB, from the same tables."""

from __future__ import annotations

from .catalogue import BETA, BUDGET, CAP, INCREMENT, RATIO, REQUEST, RHO, RUNS, TRUE

_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\W_]'), lambda x: length(x) > 0))"

_PARTS = {
    "s": ((), f"SELECT doc_id AS id, {_TOKENS.format(text='text')} AS ts FROM documents"),
    "t": (("s",), "SELECT id, unnest(ts) AS token FROM s"),
    "k": (("t",), f"SELECT * FROM (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS rn FROM t) WHERE rn < {CAP}"),
    "kn": (("k",), "SELECT *, count(*) OVER (PARTITION BY token) AS n FROM k"),
    "p": (("kn",), "SELECT a.id AS e1, b.id AS e2, a.token, a.n FROM kn a JOIN kn b ON a.token = b.token AND a.id < b.id"),
    "c": (("p",), "SELECT e1, e2, count(*) AS cbs FROM p GROUP BY e1, e2"),
    "nb": (("k",), "SELECT id, count(*) AS nb FROM k GROUP BY id"),
    "j": (("c", "nb"), "SELECT e1, e2, cbs, cbs * 1.0::DOUBLE / (a.nb + b.nb - cbs) AS w FROM c JOIN nb a ON a.id = e1 JOIN nb b ON b.id = e2"),
    "w2": (("c",), "SELECT e1, e2, cbs FROM (SELECT *, avg(cbs) OVER (PARTITION BY e2) AS m FROM c) WHERE cbs >= m"),
    "sim": (("c", "s"), "SELECT e1, e2, a.ts AS t1, b.ts AS t2, len(list_intersect(a.ts, b.ts)) AS i FROM c JOIN s a ON a.id = e1 JOIN s b ON b.id = e2"),
    "truth": (("sim",), f"SELECT e1, e2 FROM sim WHERE CASE WHEN len(t1) + len(t2) - i > 0 THEN i * 1.0::DOUBLE / (len(t1) + len(t2) - i) ELSE 0 END >= {TRUE}"),
    "m2": (("w2", "s"), "SELECT e1, e2, a.ts AS t1, b.ts AS t2, len(list_intersect(a.ts, b.ts)) AS i FROM w2 JOIN s a ON a.id = e1 JOIN s b ON b.id = e2"),
    "ms": (("m2",), "SELECT e1, e2, t1, t2, i, CASE WHEN len(t1) + len(t2) - i > 0 THEN i * 1.0::DOUBLE / (len(t1) + len(t2) - i) ELSE 0 END AS sim FROM m2"),
    "sides": (("c",), "SELECT e1, e2, cbs AS w, e1 AS node, e2 AS other FROM c UNION ALL SELECT e1, e2, cbs, e2, e1 FROM c"),
    "place": (("sides",), "SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS place, avg(w) OVER (PARTITION BY node) AS likelihood FROM sides"),
    "least": (("p",), "SELECT e1, e2, min(struct_pack(bp := n * (n - 1) // 2, token := token)) AS l, count(*) AS cbs FROM p GROUP BY e1, e2"),
    "s2": ((), f"SELECT 0 AS ds, doc_id AS id, doc_id * 2 AS seq, {_TOKENS.format(text='text')} AS ts FROM documents UNION ALL SELECT 1, item_id, item_id * 2 + 1, {_TOKENS.format(text='text')} FROM benchmark"),
    "t2": (("s2",), "SELECT ds, id, seq, unnest(ts) AS token FROM s2"),
    "v2": (("t2",), "SELECT *, CASE WHEN ds = 0 THEN count(*) FILTER (WHERE ds = 1) OVER w ELSE count(*) FILTER (WHERE ds = 0) OVER w END AS c FROM t2 WINDOW w AS (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "b2": (("v2",), f"SELECT *, min(CASE WHEN c >= 1 AND c + 1 >= {RHO} * (CASE WHEN ds = 0 THEN (SELECT count(*) FROM documents) ELSE (SELECT count(*) FROM benchmark) END) THEN seq END) OVER (PARTITION BY token) AS ban FROM v2"),
    "k2": (("b2",), "SELECT token, ds, id, seq FROM b2 WHERE ban IS NULL OR seq < ban"),
    "p2": (("k2",), "SELECT a.id AS e1, b.id AS e2, a.token FROM k2 a JOIN k2 b ON a.token = b.token AND a.ds = 0 AND b.ds = 1"),
    "c2": (("p2",), "SELECT e1, e2, count(*) AS cbs FROM p2 GROUP BY e1, e2"),
    "nt": (("s",), "SELECT id, len(ts) AS n FROM s"),
    "cls": (("s",), "SELECT s.id, min(s.id) OVER (PARTITION BY list_sort(ts), CASE WHEN len(ts) = 0 THEN text ELSE '' END) AS cluster, s.ts, len(ts) AS n FROM s JOIN documents d ON d.doc_id = s.id WHERE text IS NOT NULL"),
    "rep": (("cls",), "SELECT id, unnest(ts) AS token, n FROM cls WHERE id = cluster"),
    "near": (("rep",), f"SELECT e1, e2 FROM (SELECT a.id AS e1, b.id AS e2, count(*) AS i, any_value(a.n) AS n1, any_value(b.n) AS n2 FROM rep a JOIN rep b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id) WHERE i * 1.0::DOUBLE / (n1 + n2 - i) >= {TRUE}"),
    "every": (("cls", "near"), "SELECT a.id AS e1, b.id AS e2 FROM cls a JOIN cls b ON a.cluster = b.cluster AND a.id < b.id UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id) FROM near JOIN cls a ON a.cluster = near.e1 JOIN cls b ON b.cluster = near.e2"),
    "j2": (("w2", "j"), "SELECT e1, e2, j.w FROM w2 JOIN j USING (e1, e2)"),
    "jr": (("j2",), "SELECT e1, e2, w, row_number() OVER (ORDER BY w DESC, e1, e2) AS rank FROM j2"),
    "means": (("sides",), "SELECT node, round(avg(w), 9) AS m FROM sides GROUP BY node"),
    "bm": (("p", "c"), "SELECT token, round(avg(cbs), 9) AS m FROM p JOIN c USING (e1, e2) GROUP BY token"),
    "ov2": (("c2", "s2"), "SELECT e1, e2, len(list_intersect(a.ts, b.ts)) * 1.0::DOUBLE / least(len(a.ts), len(b.ts)) AS sim FROM c2 JOIN s2 a ON a.ds = 0 AND a.id = e1 JOIN s2 b ON b.ds = 1 AND b.id = e2"),
    "pd2": (("k2",), "SELECT a.id AS e1, b.id AS e2, a.token, greatest(a.seq, b.seq) AS came, CASE WHEN b.seq > a.seq THEN 1 ELSE 0 END AS node_ds, CASE WHEN b.seq > a.seq THEN b.id ELSE a.id END AS node FROM k2 a JOIN k2 b ON a.token = b.token AND a.ds = 0 AND b.ds = 1"),
    "cd2": (("pd2",), "SELECT e1, e2, node_ds, node, came, count(*) AS cbs FROM pd2 GROUP BY ALL"),
    "wd2": (("cd2",), "SELECT e1, e2, cbs, came FROM (SELECT *, avg(cbs) OVER (PARTITION BY node_ds, node) AS m FROM cd2) WHERE cbs >= m"),
    "nb2": (("k2",), "SELECT ds, id, count(*) AS nb FROM k2 GROUP BY ds, id"),
    "gh": (("k",), f"SELECT id, token FROM (SELECT id, token, rn, min(rn) OVER (PARTITION BY id) AS least FROM k WHERE rn > 1) WHERE rn * {BETA} < least"),
    "size": ((), f"SELECT greatest(1, CAST(ceil(count(*) / {RUNS}.0) AS BIGINT)) AS size FROM documents"),
}


def _sql(body: str, *parts: str) -> str:
    """A query over the named parts, with all that they build on."""
    need: list[str] = []

    def add(name: str) -> None:
        for below in _PARTS[name][0]:
            add(below)
        if name not in need:
            need.append(name)

    for part in parts:
        add(part)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in need) + "\n" + body if need else body


_K_SUM = "(SELECT sum(n) FROM (SELECT count(*) AS n FROM k GROUP BY token HAVING count(*) > 1))"
_PER_NODE = f"greatest(1, {_K_SUM} // greatest(1, (SELECT count(*) FROM documents)))"
_SIDE_TEST = "SELECT e1, e2, max(w) AS w FROM ({}) GROUP BY e1, e2 HAVING sum(ok) >= 2"


def _rerun() -> str:
    """Each run's top pairs among those no earlier run took."""
    parts = []
    for i in range(RUNS):
        skip = "".join(f" AND NOT EXISTS (SELECT 1 FROM r{j} WHERE r{j}.e1 = c.e1 AND r{j}.e2 = c.e2)" for j in range(i))
        parts.append(f"r{i} AS (SELECT {i} AS run, row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, w FROM (SELECT e1, e2, cbs AS w FROM c WHERE e2 < {i + 1} * (SELECT size FROM size){skip} ORDER BY cbs DESC, e1, e2 LIMIT 1000))")
    return _sql("SELECT 1", "c", "size").removesuffix("\nSELECT 1") + ",\n" + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(RUNS))


def _stream(open_: str, order: str, *parts: str, newest: bool = False, size: str = "(SELECT size FROM size)", rounds: bool = False) -> str:
    """A stream's requests: after increment i the best REQUEST of `open_` (e1, e2, w, came: arrival of the later end, and what the order
    needs) that arrived so far and didn't go out before; then on to BUDGET. newest: only pairs of the newest increment wait."""
    steps, n = [f"open_ AS MATERIALIZED (SELECT *, came // {size} AS inc FROM ({open_}))"], BUDGET // REQUEST
    for i in range(n):
        skip = f" AND NOT EXISTS (SELECT 1 FROM sent{i - 1} x WHERE x.e1 = o.e1 AND x.e2 = o.e2)" if i else ""
        waits = f"inc {'=' if newest else '<='} {min(i, RUNS - 1)}"
        queue = f"SELECT * FROM open_ o WHERE {waits}{skip}"
        if rounds:
            ends = f"SELECT *, e1 AS node, e2 AS other FROM ({queue}) UNION ALL SELECT *, e2, e1 FROM ({queue})"
            queue = f"SELECT e1, e2, any_value(w) AS w, min(place) AS round FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS place FROM ({ends})) GROUP BY e1, e2"
        steps.append(f"r{i} AS MATERIALIZED (SELECT {i} AS request, row_number() OVER (ORDER BY {order}) AS rank, e1, e2, w FROM ({queue}) QUALIFY rank <= {REQUEST})")
        before = f"SELECT * FROM sent{i - 1} UNION ALL " if i else ""
        steps.append(f"sent{i} AS MATERIALIZED ({before}SELECT e1, e2 FROM r{i})")
    head = _sql("SELECT 1", *parts, "size").removesuffix("\nSELECT 1")
    return head + ",\n" + ",\n".join(steps) + "\n" + " UNION ALL ".join(f"SELECT request, rank, e1, e2, round(w, 6) AS w FROM r{i}" for i in range(n))


def _stream_log() -> str:
    """The log of stream_ipcs: its requests in order stand for the ranks."""
    head, body = _stream("SELECT e1, e2, w, e2 AS came FROM j2", "w DESC, e1, e2", "j2", "s", "ms", "every").rsplit("\nSELECT request", 1)
    sent = f",\nst AS (SELECT e1, e2, request AS increment, row_number() OVER (ORDER BY request, rank) AS rank FROM (SELECT request{body}))"
    source = "SELECT rank, jr.e2 // {increment} AS increment", "FROM jr JOIN ms ON ms.e1 = jr.e1 AND ms.e2 = jr.e2 LEFT JOIN every ON every.e1 = jr.e1 AND every.e2 = jr.e2", "len(t1) + len(t2) AS size"
    log = _METRICS.replace(source[0], "SELECT rank, increment").replace(source[1], source[1].replace("jr", "st")).replace(source[2], "0 AS size")
    return head + sent + log


_METRICS = """
SELECT ec, round(ec * 1.0::DOUBLE / n, 6) AS ec_x, increment, em, round(em * 1.0::DOUBLE / n, 6) AS pc, n AS duplicates, matches, true_matches, round(true_matches * 1.0::DOUBLE / n, 6) AS recall,
       CASE WHEN matches > 0 THEN round(true_matches * 1.0::DOUBLE / matches, 6) ELSE 0 END AS precision, ec - lag(ec, 1, 0) OVER w AS comps,
       round((tokens - lag(tokens, 1, 0) OVER w) * 1.0::DOUBLE / (ec - lag(ec, 1, 0) OVER w), 6) AS compsize, 'icps' AS method, 'js' AS ranking
FROM (SELECT rank AS ec, increment, hit, CAST(sum(hit) OVER r AS BIGINT) AS em, CAST(sum(m) OVER r AS BIGINT) AS matches, CAST(sum(m * hit) OVER r AS BIGINT) AS true_matches, CAST(sum(size) OVER r AS BIGINT) AS tokens,
        (SELECT greatest(1, count(*)) FROM every) AS n, count(*) OVER () AS last
      FROM (SELECT rank, jr.e2 // {increment} AS increment, CASE WHEN every.e1 IS NULL THEN 0 ELSE 1 END AS hit, CAST(ms.sim >= 0.1 AS BIGINT) AS m, len(t1) + len(t2) AS size
            FROM jr JOIN ms ON ms.e1 = jr.e1 AND ms.e2 = jr.e2 LEFT JOIN every ON every.e1 = jr.e1 AND every.e2 = jr.e2) WINDOW r AS (ORDER BY rank))
WHERE floor(em * 1.0::DOUBLE / n / 0.02 + 1e-9) > floor((em - hit) * 1.0::DOUBLE / n / 0.02 + 1e-9) OR ((SELECT count(*) FROM every) > 0 AND ec % n = 0) OR ec = last
WINDOW w AS (ORDER BY ec)
"""

_HALVED = """
, l AS (SELECT e1, e2, w, CAST(floor(least(10, floor(w * 10 * 1024) / 1024) * 1024) AS BIGINT) AS leaf FROM j),
lc AS (SELECT leaf, count(*) AS c FROM l GROUP BY leaf),
ld AS (SELECT leaf, CASE {cases} ELSE 10 END AS depth FROM lc)
SELECT e1, e2, round(w, 6) AS w, CAST(depth AS BIGINT) AS depth, leaf // CAST(pow(2, 10 - depth) AS BIGINT) AS bucket FROM l JOIN ld USING (leaf)
""".format(cases=" ".join(f"WHEN sum(c) OVER (PARTITION BY leaf // {1 << (10 - d)}) <= 500 THEN {d}" for d in range(10)))

_BLOOM = """
, top AS (SELECT e1, e2 FROM j ORDER BY w DESC, e1, e2 LIMIT 1000),
h AS (SELECT id, list_sort(list_distinct(flatten(list_transform(ts, lambda t: list_transform(range(0, 4), lambda i: (('0x' || substr(md5(t), 1, 8))::BIGINT + i * ('0x' || substr(md5(t), 9, 8))::BIGINT) % 4096))))) AS bits, len(ts) AS n
      FROM s WHERE id IN (SELECT e1 FROM top UNION SELECT e2 FROM top))
SELECT e1, e2, round(CASE WHEN least(len(a.bits), len(b.bits)) > 0 THEN len(list_intersect(a.bits, b.bits)) * 1.0::DOUBLE / least(len(a.bits), len(b.bits))
         - CASE WHEN greatest(len(a.bits), len(b.bits)) > 4096 - 0.1 THEN least(1.0, (CASE WHEN len(a.bits) < len(b.bits) THEN b.n ELSE a.n END - 4096 + 0.1) / greatest(1, CASE WHEN len(a.bits) < len(b.bits) THEN a.n ELSE b.n END)) ELSE 0 END
       ELSE 0 END, 6) AS sim
FROM top JOIN h a ON a.id = e1 JOIN h b ON b.id = e2
"""


def _unique_mapping() -> str:
    """Rounds of mutually best pairs as a recursion: a round's rows are those that no earlier round took an end of."""
    best = "row_number() OVER (PARTITION BY {0}e1 ORDER BY sim DESC, e1, e2) AS a, row_number() OVER (PARTITION BY {0}e2 ORDER BY sim DESC, e1, e2) AS b"
    return _sql("SELECT 1", "ov2").removesuffix("\nSELECT 1") + f""",
r AS (
  SELECT 0 AS round, e1, e2, sim FROM ov2 WHERE sim > 0.1
  UNION ALL SELECT round + 1, e1, e2, sim FROM (
    SELECT *, max(won) OVER (PARTITION BY e1) AS m1, max(won) OVER (PARTITION BY e2) AS m2 FROM (
      SELECT *, CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END AS won FROM (SELECT *, {best.format('')} FROM r))) WHERE m1 = 0 AND m2 = 0)
SELECT e1, e2, round(sim, 6) AS sim FROM (SELECT *, {best.format('round, ')} FROM r) WHERE a = 1 AND b = 1"""


ORACLES: dict[str, str] = {
    "tokenize_documents": _sql("SELECT id, token FROM t", "t"),
    "token_block_sizes": _sql("SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) > 1", "t"),
    "block_comparison_count": _sql("SELECT count(*) AS blocks, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS comparisons FROM (SELECT count(*) AS n FROM t GROUP BY token HAVING count(*) > 1)", "t"),
    "block_comparison_count_clean_clean": _sql("SELECT count(*) AS blocks, CAST(coalesce(sum(n1 * n2), 0) AS BIGINT) AS comparisons FROM (SELECT count(*) FILTER (WHERE ds = 0) AS n1, count(*) FILTER (WHERE ds = 1) AS n2 FROM t2 GROUP BY token) WHERE n1 > 0 AND n2 > 0", "t2"),
    "block_pruning_arrival_order": _sql("SELECT token, id, rn FROM k", "k"),
    "block_pruning_clean_clean": _sql("SELECT token, CAST(ds AS BIGINT) AS ds, id FROM k2", "k2"),
    "block_ghosting": _sql(f"SELECT id, token, c FROM (SELECT id, token, rn - 1 AS c, min(rn) OVER (PARTITION BY id) AS least FROM k WHERE rn > 1) WHERE (c + 1) * {BETA} < least", "k"),
    "block_filtering": _sql(f"SELECT id, token, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, token) AS place, count(*) OVER (PARTITION BY id) AS k FROM kn WHERE n > 1) WHERE place <= ceil(k * {RATIO}::DOUBLE)", "kn"),
    "size_based_purging": _sql(f"SELECT token, count(*) AS n, count(*) * (count(*) - 1) // 2 AS block_pairs FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND {CAP}", "t"),
    "raw_comparisons_dirty": _sql(f"SELECT e2 // {INCREMENT} AS increment, count(*) AS comparisons FROM p GROUP BY 1", "p"),
    "raw_comparisons_clean_clean": _sql("SELECT e2, count(*) AS comparisons FROM p2 GROUP BY e2", "p2"),
    "cbs_pairs": _sql("SELECT * FROM c", "c"),
    "wnp": _sql("SELECT e1, e2, cbs FROM (SELECT *, avg(cbs) OVER (PARTITION BY e2) AS m FROM c) WHERE cbs > m", "c"),
    "wnp2": _sql("SELECT * FROM w2", "w2"),
    "cnp": _sql("SELECT e1, e2, cbs FROM (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY cbs DESC, e1) AS place, ceil(sum(cbs) OVER (PARTITION BY e2) * 1.0::DOUBLE / count(*) OVER (PARTITION BY e2) - 1) AS k FROM c) WHERE place <= k", "c"),
    "js_weight": _sql("SELECT e1, e2, round(w, 6) AS w FROM j", "j"),
    "bjs_weight": _sql("SELECT e1, e2, round(cbs * 100.0::DOUBLE / (a.nb + b.nb - cbs), 6) AS w FROM w2 JOIN nb a ON a.id = e1 JOIN nb b ON b.id = e2", "w2", "nb"),
    "normalized_cbs": _sql("SELECT e1, e2, round(cbs * 1.0::DOUBLE / keys, 6) AS w FROM c JOIN (SELECT e2, count(DISTINCT token) AS keys FROM p GROUP BY e2) USING (e2)", "c"),
    "cbs_max": _sql("SELECT e1, e2, round(cbs * 1.0::DOUBLE / greatest(1, m), 6) AS w FROM c JOIN (SELECT e2, max(max(cbs)) OVER (ORDER BY e2) AS m FROM c GROUP BY e2) USING (e2)", "c"),
    "arcs_weight": _sql("SELECT e1, e2, round(sum(1.0::DOUBLE / (n * (n - 1) / 2)), 6) AS w FROM p GROUP BY e1, e2", "p"),
    "wep": _sql("SELECT e1, e2, cbs AS w FROM c WHERE cbs >= (SELECT avg(cbs) FROM c)", "c"),
    "cep": _sql(f"SELECT e1, e2, w FROM (SELECT e1, e2, cbs AS w, row_number() OVER (ORDER BY cbs DESC, e1, e2) AS place FROM c) WHERE place <= {_K_SUM} // 2", "c"),
    "reciprocal_wnp": _sql(_SIDE_TEST.format("SELECT *, CAST(w >= likelihood AS INT) AS ok FROM place"), "place"),
    "reciprocal_cnp": _sql(_SIDE_TEST.format(f"SELECT *, CAST(place <= {_PER_NODE} AS INT) AS ok FROM place"), "place"),
    "jaccard_match": _sql("SELECT e1, e2, round(sim, 6) AS sim FROM ms", "ms"),
    "overlap_match": _sql("SELECT e1, e2, CASE WHEN least(len(t1), len(t2)) > 0 THEN round(i * 1.0::DOUBLE / least(len(t1), len(t2)), 6) ELSE 0 END AS sim FROM m2", "m2"),
    "ipcs_topk": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, round(w, 6) AS w FROM (SELECT * FROM j ORDER BY w DESC, e1, e2 LIMIT 1000)", "j"),
    "ipbs_order": _sql("SELECT row_number() OVER (ORDER BY l.bp, cbs DESC, e1, e2) AS rank, e1, e2, l.bp AS bp, cbs FROM least", "least"),
    "ipes_rounds": _sql("SELECT row_number() OVER (ORDER BY round, v DESC, e1, e2) AS rank, e1, e2, round, CASE WHEN round <= 60 THEN 1 ELSE 2 END AS tier, round(v, 6) AS w FROM (SELECT e1, e2, min(place) AS round, max(w) AS v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS place FROM (SELECT e1, e2, w, e1 AS node, e2 AS other FROM j UNION ALL SELECT e1, e2, w, e2, e1 FROM j)) GROUP BY e1, e2)", "j"),
    "iapcs_tiers": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, ntile(4) OVER (ORDER BY w DESC, e1, e2) AS tier, e1, e2, round(w, 6) AS w FROM j", "j"),
    "local_sort_by_increment": _sql(f"SELECT e2 // {INCREMENT} AS increment, row_number() OVER (PARTITION BY e2 // {INCREMENT} ORDER BY w DESC, e1, e2) AS rank, e1, e2, round(w, 6) AS w FROM j", "j"),
    "pgtc": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, w FROM (SELECT e1, e2, cbs AS w FROM c ORDER BY cbs DESC, e1, e2 LIMIT 5000)", "c"),
    "pltc": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, w FROM (SELECT DISTINCT e1, e2, w FROM place WHERE place <= 5)", "place"),
    "pbs": _sql("SELECT row_number() OVER (ORDER BY l.bp, l.token, cbs DESC, e1, e2) AS rank, e1, e2, l.bp AS bp, l.token AS token, cbs FROM least", "least"),
    "pes": _sql(
        "SELECT row_number() OVER (ORDER BY stage, likelihood DESC, entity, w DESC, e1, e2) AS rank, stage, entity, e1, e2, w FROM ("
        "SELECT DISTINCT 1 AS stage, 0.0::DOUBLE AS likelihood, 0 AS entity, e1, e2, w FROM place WHERE place = 1 UNION ALL "
        "SELECT 2, likelihood, node, e1, e2, w FROM (SELECT *, row_number() OVER (PARTITION BY e1, e2 ORDER BY likelihood DESC, node) AS o FROM place WHERE place BETWEEN 2 AND 11 AND (e1, e2) NOT IN (SELECT (e1, e2) FROM place WHERE place = 1)) WHERE o = 1)", "place"),
    "cep_cnp_union": _sql(f"SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, w FROM (SELECT DISTINCT e1, e2, w FROM place WHERE place <= 10 * {_PER_NODE})", "place"),
    "entity_weight_arcs": _sql("SELECT id, round(sum(1.0::DOUBLE / (n * (n - 1) / 2)), 6) AS w FROM kn WHERE n > 1 GROUP BY id", "kn"),
    "entity_rank": _sql("SELECT node AS id, round(avg(w), 6) AS mean_w, max(w) AS max_w FROM sides GROUP BY node", "sides"),
    "block_rank": _sql("SELECT token, round(m, 6) AS mean_w, round(m, 9) > (SELECT avg(round(m, 9)) FROM b) AS good FROM b".replace("FROM b)", "FROM (SELECT avg(cbs) AS m FROM p JOIN c USING (e1, e2) GROUP BY token))").replace(" FROM b", " FROM (SELECT token, avg(cbs) AS m FROM p JOIN c USING (e1, e2) GROUP BY token)"), "c"),
    "bucket_queue_order": _sql("SELECT CAST(least(10, floor(w * 10)) AS BIGINT) AS bucket, e1, e2, round(w, 6) AS w FROM j", "j"),
    "connected_components": _sql(
        "SELECT id, min(o) AS cluster FROM reach GROUP BY id".replace("reach", "r"), "truth").replace(
        "\nSELECT id", ",\ne AS (SELECT e1 AS a, e2 AS b FROM truth UNION SELECT e2, e1 FROM truth),\nr AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a)\nSELECT id"),
    "pc_pq_metrics": _sql("SELECT comparisons, found, truth, coalesce(round(found * 1.0::DOUBLE / nullif(truth, 0), 6), 0) AS pc, coalesce(round(found * 1.0::DOUBLE / nullif(comparisons, 0), 6), 0) AS pq FROM (SELECT (SELECT count(*) FROM w2) AS comparisons, (SELECT count(*) FROM w2 JOIN truth USING (e1, e2)) AS found, (SELECT count(*) FROM truth) AS truth)", "w2", "truth"),
    "progressive_recall_curve": _sql("SELECT rank, e1, e2, count(*) OVER (ORDER BY rank) AS found, round(count(*) OVER (ORDER BY rank) * 1.0::DOUBLE / (SELECT count(*) FROM truth), 6) AS pc FROM (SELECT e1, e2, row_number() OVER (ORDER BY w DESC, e1, e2) AS rank FROM j) JOIN truth USING (e1, e2)", "j", "truth"),
    "recall_precision_at_threshold": _sql("SELECT count(*) AS matches, count(*) FILTER (WHERE h) AS true_matches, coalesce(round(count(*) FILTER (WHERE h) * 1.0::DOUBLE / nullif((SELECT count(*) FROM truth), 0), 6), 0) AS recall, coalesce(round(count(*) FILTER (WHERE h) * 1.0::DOUBLE / nullif(count(*), 0), 6), 0) AS precision FROM (SELECT ms.e1, ms.e2, truth.e1 IS NOT NULL AS h FROM ms LEFT JOIN truth ON ms.e1 = truth.e1 AND ms.e2 = truth.e2 WHERE sim >= 0.5)", "ms", "truth"),
    "mean_comparison_size": _sql("SELECT round(avg(len(t1) + len(t2)), 6) AS mean_size FROM m2", "m2"),
    "stream_incremental_cbs": _sql("SELECT * FROM c", "c"),
    "stream_incremental_metrics": _sql("SELECT c.e2 // (SELECT size FROM size) AS increment, count(*) AS comparisons, count(truth.e1) AS found FROM c LEFT JOIN truth ON c.e1 = truth.e1 AND c.e2 = truth.e2 GROUP BY 1", "c", "truth", "size"),
    "clean_clean_end_to_end": _sql("SELECT e1, e2, round(CASE WHEN len(a.ts) + len(b.ts) > 0 THEN len(list_intersect(a.ts, b.ts)) * 1.0::DOUBLE / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) ELSE 0 END, 6) AS sim FROM (SELECT e1, e2 FROM (SELECT *, avg(cbs) OVER (PARTITION BY e2) AS m FROM c2) WHERE cbs >= m) JOIN s2 a ON a.ds = 0 AND a.id = e1 JOIN s2 b ON b.ds = 1 AND b.id = e2", "c2"),
    "incremental_rerun_baseline": _rerun(),
    "fallback_block_walk": _sql("SELECT e1, e2, l.bp AS bp, cbs FROM least WHERE (e1, e2) NOT IN (SELECT (e1, e2) FROM w2)", "least", "w2"),
    "ground_truth_classes": _sql("SELECT id, cluster FROM cls", "cls"),
    "ground_truth_links": _sql("SELECT e1, e2 FROM near", "near"),
    "ground_truth_clusters": _sql("SELECT 1", "every").removesuffix("\nSELECT 1") + ",\ne AS (SELECT e1 AS a, e2 AS b FROM every UNION SELECT e2, e1 FROM every),\nr AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a)\nSELECT id, min(o) AS cluster FROM r GROUP BY id",
    "completeness_of_all_truth": _sql("SELECT comparisons, found, truth, coalesce(round(found * 1.0::DOUBLE / nullif(truth, 0), 6), 0) AS pc, coalesce(round(found * 1.0::DOUBLE / nullif(comparisons, 0), 6), 0) AS pq FROM (SELECT (SELECT count(*) FROM w2) AS comparisons, (SELECT count(*) FROM w2 JOIN every USING (e1, e2)) AS found, (SELECT count(*) FROM every) AS truth)", "w2", "every"),
    "metrics_log": _sql(_METRICS.replace("{increment}", str(INCREMENT)), "jr", "ms", "every"),
    "match_event_log": _sql("SELECT rank, e1 || '-' || e2 AS pair, count(*) OVER (ORDER BY rank) AS found, round(count(*) OVER (ORDER BY rank) * 1.0::DOUBLE / (SELECT count(*) FROM every), 6) AS pc, 'icps' AS method FROM jr JOIN every USING (e1, e2)", "jr", "every"),
    "block_pruning_rho": _sql(f"SELECT token, id, rn FROM (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS rn FROM t) WHERE rn = 1 OR rn < {BETA}::DOUBLE * (SELECT count(*) FROM documents)", "t"),
    "raw_comparisons_uncapped": _sql(f"SELECT id // {INCREMENT} AS increment, CAST(sum(rn - 1) AS BIGINT) AS comparisons FROM (SELECT id, row_number() OVER (PARTITION BY token ORDER BY id) AS rn FROM t) GROUP BY 1 HAVING sum(rn - 1) > 0", "t"),
    "block_probe_classes": _sql(f"SELECT id, found, count(*) AS n FROM (SELECT id, CASE WHEN rn = 1 THEN 'empty' WHEN rn < {CAP} THEN 'admissible' ELSE 'oversize' END AS found FROM (SELECT id, row_number() OVER (PARTITION BY token ORDER BY id) AS rn FROM t)) GROUP BY id, found", "t"),
    "block_lookup": _sql("SELECT token, id FROM k WHERE token IN (SELECT token FROM t2 WHERE ds = 1)", "k", "t2"),
    "associated_entities": _sql("SELECT a.id, b.id AS other, count(*) AS n FROM k a JOIN k b ON a.token = b.token AND a.id != b.id WHERE length(a.token) >= 4 GROUP BY a.id, b.id", "k"),
    "wnp2_dropped": _sql("SELECT e1, e2, cbs FROM (SELECT *, avg(cbs) OVER (PARTITION BY e2) AS m FROM c) WHERE cbs < m", "c"),
    "approximate_cbs": _sql("SELECT * FROM w2", "w2"),
    "js_by_arrival_clean_clean": _sql("SELECT e1, e2, round(cbs * 1.0::DOUBLE / (a.nb + b.nb - cbs), 6) AS w FROM wd2 JOIN nb2 a ON a.ds = 0 AND a.id = e1 JOIN nb2 b ON b.ds = 1 AND b.id = e2", "wd2", "nb2"),
    "pps_stage": _sql(
        "SELECT row_number() OVER (ORDER BY stage, turn, m DESC, entity, w DESC, e1, e2) AS rank, stage, e1, e2, w FROM (SELECT 1 AS stage, e2 AS turn, 0.0::DOUBLE AS m, 0 AS entity, e1, e2, w FROM a WHERE n <= 3 "
        "UNION ALL SELECT 2, 0, m, e1, e1, e2, w FROM (SELECT e1, e2, w, round(avg(w) OVER (PARTITION BY e1), 9) AS m, row_number() OVER (PARTITION BY e1 ORDER BY w DESC, e2) AS place FROM a WHERE n > 3) WHERE place <= 15)", "c").replace(
        "\nSELECT row_number", ",\na AS (SELECT e1, e2, cbs AS w, row_number() OVER (PARTITION BY e2 ORDER BY cbs DESC, e1) AS n FROM c)\nSELECT row_number", 1),
    "bounded_tiers": _sql("SELECT rank, CASE WHEN rank <= 2000 THEN 1 WHEN rank <= 2200 THEN 2 WHEN rank <= 2220 THEN 3 ELSE 4 END AS tier, e1, e2, round(w, 6) AS w FROM (SELECT *, row_number() OVER (ORDER BY w DESC, e1, e2) AS rank FROM j) WHERE rank <= 2222", "j"),
    "bucket_queue_bounded": _sql("SELECT b AS bucket, e1, e2, round(w, 6) AS w FROM (SELECT *, count(*) OVER (ORDER BY b DESC) AS upto FROM (SELECT *, CAST(least(10, floor(w * 10)) AS BIGINT) AS b FROM j)) WHERE upto <= 2000", "j"),
    "bucket_queue_halved": _sql("SELECT 1", "j").removesuffix("\nSELECT 1") + _HALVED,
    "arrival_order": _sql("SELECT row_number() OVER (ORDER BY e2, e1) AS rank, e1, e2, cbs AS w FROM c", "c"),
    "similarity_queue": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, round(w, 6) AS w FROM (SELECT e1, e2, CASE WHEN least(len(t1), len(t2)) > 0 THEN round(i * 1.0::DOUBLE / least(len(t1), len(t2)), 9) ELSE 0 END AS w FROM m2 ORDER BY w DESC, e1, e2 LIMIT 1000)", "m2"),
    "entities_in_good_blocks": _sql(
        "SELECT row_number() OVER (ORDER BY greatest(a.m, b.m) DESC, CASE WHEN a.m > b.m OR (a.m = b.m AND e1 < e2) THEN e1 ELSE e2 END, cbs DESC, e1, e2) AS rank, CASE WHEN a.m > b.m OR (a.m = b.m AND e1 < e2) THEN e1 ELSE e2 END AS entity, e1, e2, cbs AS w "
        "FROM (SELECT DISTINCT e1, e2 FROM p WHERE token IN (SELECT token FROM bm WHERE m > (SELECT avg(m) FROM bm))) JOIN c USING (e1, e2) JOIN means a ON a.node = e1 JOIN means b ON b.node = e2", "bm", "means"),
    "block_cardinality_order": _sql("SELECT row_number() OVER (ORDER BY w DESC, e1, e2) AS rank, e1, e2, round(w, 6) AS w FROM (SELECT e1, e2, round(cbs * 1.0::DOUBLE / l.bp, 9) AS w FROM least)", "least"),
    "bloom_match": _sql("SELECT 1", "j", "s").removesuffix("\nSELECT 1") + _BLOOM,
    "unique_mapping": _unique_mapping(),
    "clean_clean_components": _sql("SELECT 1", "ov2").removesuffix("\nSELECT 1") + ",\nm AS (SELECT e1, e2 + (SELECT max(e1) + 1 FROM ov2 WHERE sim > 0.5) AS e2 FROM ov2 WHERE sim > 0.5),\ne AS (SELECT e1 AS a, e2 AS b FROM m UNION SELECT e2, e1 FROM m),\nr AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a)\nSELECT CAST(id > (SELECT max(e1) FROM m) AS BIGINT) AS ds, CASE WHEN id > (SELECT max(e1) FROM m) THEN id - (SELECT max(e1) FROM m) - 1 ELSE id END AS id, min(o) AS cluster FROM r GROUP BY r.id",
    "stream_ipcs": _stream("SELECT e1, e2, w, e2 AS came FROM j2", "w DESC, e1, e2", "j2"),
    "stream_metrics_log": _stream_log(),
    "stream_ipes": _stream("SELECT e1, e2, w * 100 AS w, e2 AS came FROM j2", "round > 60, round, w DESC, e1, e2", "j2", rounds=True),
    "stream_ipbs": _stream("SELECT e1, e2, cbs * 1.0::DOUBLE AS w, cbs, e2 AS came, bp FROM w2 JOIN (SELECT a.id AS e1, b.id AS e2, min(b.m * (b.m - 1) // 2) AS bp FROM k a JOIN (SELECT id, token, count(*) OVER (PARTITION BY token ORDER BY id // (SELECT size FROM size)) AS m FROM k) b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id) USING (e1, e2)", "bp, cbs DESC, e1, e2", "w2", "size"),
    "stream_local_sort": _stream("SELECT e1, e2, cbs * 1.0::DOUBLE AS w, e2 AS came FROM w2", "w DESC, e1, e2", "w2", newest=True),
    "stream_ghosted": _stream("SELECT a.id AS e1, b.id AS e2, count(*) * 1.0::DOUBLE AS w, b.id AS came FROM k a JOIN k b ON a.token = b.token AND a.id < b.id WHERE EXISTS (SELECT 1 FROM gh WHERE gh.id = b.id AND gh.token = b.token) GROUP BY a.id, b.id", "w DESC, e1, e2", "k", "gh"),
    "stream_clean_clean": _stream("SELECT e1, e2, cbs * 1.0::DOUBLE AS w, came FROM wd2", "w DESC, e1, e2", "wd2", size="(SELECT 2 * size FROM size)"),
}
