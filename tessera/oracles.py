"""SQL that says what the registered queries of the matching engine must return."""

from __future__ import annotations

from .queries import COLUMNS, REAL_TRUTH, ROWS, TRUTH


def cells_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t in names for c in COLUMNS[t])


def jaccard_sql(close: str, sources: tuple[str, ...], targets: tuple[str, ...]) -> str:
    return f"""
WITH s AS (SELECT DISTINCT * FROM ({cells_sql(*sources)})), t AS (SELECT DISTINCT * FROM ({cells_sql(*targets)})),
ns AS (SELECT tbl, col, count(*) AS n FROM s GROUP BY ALL), nt AS (SELECT tbl, col, count(*) AS n FROM t GROUP BY ALL),
hits AS (SELECT s.tbl AS st, s.col AS sc, t.tbl AS tt, t.col AS tc, count(DISTINCT s.v) AS hs, count(DISTINCT t.v) AS ht
  FROM s JOIN t ON {close.format(a='s.v', b='t.v')} GROUP BY ALL),
c AS (SELECT st, sc, tt, tc, CASE WHEN ns.n < nt.n THEN hs ELSE ht END AS h, ns.n AS a, nt.n AS b
  FROM hits JOIN ns ON ns.tbl = st AND ns.col = sc JOIN nt ON nt.tbl = tt AND nt.col = tc)
SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, round(h / (a + b - h), 6) AS similarity FROM c WHERE h > 0"""


EDIT = "1 - {d}({{a}}, {{b}}) / greatest(length({{a}}), length({{b}}), 1) >= 0.8"
HAMMING = "1 - (hamming(left({a}, least(length({a}), length({b}))), left({b}, least(length({a}), length({b})))) + abs(length({a}) - length({b}))) / greatest(length({a}), length({b}), 1) >= 0.8"
RANKED = "row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(v, '^[ \\t]*(-?[0-9]*\\.?[0-9]*)', 1) AS DECIMAL(38,10)), 0), v)"
RANKS = f"""
cells AS ({cells_sql('customer', 'supplier')}),
ranks AS (SELECT v, {RANKED} AS r FROM (SELECT DISTINCT v FROM cells)),
keyed AS (SELECT v, max(r) OVER (PARTITION BY coalesce(CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR), 's' || v)) AS rank FROM ranks),
rows_ AS (SELECT tbl, col, v, rank FROM cells JOIN keyed USING (v)),
raw AS (SELECT tbl, col, low, unnest(qs) AS q FROM (SELECT tbl, col, min(rank) AS low, quantile_cont(CAST(rank AS DOUBLE), list_transform(range(1, 257), lambda k: k / 257.0)) AS qs FROM rows_ GROUP BY ALL)),
bounds AS (SELECT tbl, col, min(low) AS low, list_sort(list(DISTINCT round_even(q, 3))) AS b FROM raw GROUP BY ALL)"""


def hist_sql(name: str, rows: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, len(list_filter(b, lambda x: x < rank)) AS k, count(*) AS m FROM ({rows}) WHERE rank >= low AND rank <= b[len(b)] GROUP BY ALL)"


EMD_RAW = f"""{RANKS},
s AS (SELECT col AS sc, rank, low, b FROM rows_ JOIN bounds USING (tbl, col) WHERE tbl = 'customer'),
t AS (SELECT col AS tc, rank FROM rows_ WHERE tbl = 'supplier'),
sb AS (SELECT col AS sc, low, b FROM bounds WHERE tbl = 'customer'),
tn AS (SELECT DISTINCT tc FROM t),
{hist_sql('hs', 'SELECT * FROM s', 'sc')},
{hist_sql('ht', 'SELECT sb.sc, t.tc, t.rank, sb.low, sb.b FROM t, sb', 'sc, tc')},
grid AS (SELECT sc, tc, len(b) AS n, unnest(range(0, len(b))) AS k FROM sb, tn),
g AS (SELECT grid.*, coalesce(hs.m, 0) AS a, coalesce(ht.m, 0) AS c FROM grid LEFT JOIN hs USING (sc, k) LEFT JOIN ht USING (sc, tc, k)),
ew AS (SELECT sc, tc, n, sum(a) OVER p AS ra, sum(c) OVER p AS rc, sum(a) OVER (PARTITION BY sc, tc) AS ta, sum(c) OVER (PARTITION BY sc, tc) AS tc_ FROM g WINDOW p AS (PARTITION BY sc, tc ORDER BY k)),
emd AS (SELECT sc, tc, CASE WHEN min(ta) = 0 OR min(tc_) = 0 THEN NULL ELSE sum(abs(ra / ta - rc / tc_)) / max(n) END AS emd FROM ew GROUP BY ALL)"""


def intersection_sql() -> str:
    """Distances of each column to the rows of both whose value they share, and their mean."""
    out = """
keyrows AS (SELECT tbl, col, rank, count(*) AS f FROM rows_ GROUP BY ALL),
common AS (SELECT a.col AS sc, b.col AS tc, a.rank, a.f + b.f AS f FROM keyrows a JOIN keyrows b ON a.rank = b.rank AND a.tbl = 'customer' AND b.tbl = 'supplier')"""
    for side, tbl, col in (("x", "customer", "sc"), ("y", "supplier", "tc")):
        out += f""",
{side}b AS (SELECT col AS {col}, low, b FROM bounds WHERE tbl = '{tbl}'),
{side}l AS (SELECT {col}, len(list_filter(b, lambda z: z < rank)) AS k, sum(f) AS m FROM (SELECT {col}, rank, f, low, b FROM keyrows JOIN {side}b ON col = {col} AND tbl = '{tbl}') WHERE rank >= low AND rank <= b[len(b)] GROUP BY ALL),
{side}r AS (SELECT sc, tc, len(list_filter(b, lambda z: z < rank)) AS k, sum(f) AS m FROM (SELECT sc, tc, rank, f, low, b FROM common JOIN {side}b USING ({col})) WHERE rank >= low AND rank <= b[len(b)] GROUP BY ALL),
{side}g AS (SELECT sc, tc, len(b) AS n, unnest(range(0, len(b))) AS k FROM (SELECT DISTINCT sc, tc FROM common) JOIN {side}b USING ({col})),
{side}w AS (SELECT g.sc, g.tc, n, sum(coalesce(l.m, 0)) OVER p AS ra, sum(coalesce(r.m, 0)) OVER p AS rc, sum(coalesce(l.m, 0)) OVER (PARTITION BY g.sc, g.tc) AS ta, sum(coalesce(r.m, 0)) OVER (PARTITION BY g.sc, g.tc) AS tc_
  FROM {side}g g LEFT JOIN {side}l l ON l.{col} = g.{col} AND l.k = g.k LEFT JOIN {side}r r ON r.sc = g.sc AND r.tc = g.tc AND r.k = g.k WINDOW p AS (PARTITION BY g.sc, g.tc ORDER BY g.k)),
{side}e AS (SELECT sc, tc, CASE WHEN min(ta) = 0 OR min(tc_) = 0 THEN NULL ELSE sum(abs(ra / ta - rc / tc_)) / max(n) END AS e FROM {side}w GROUP BY ALL)"""
    return out + """,
shared AS (SELECT p.sc, p.tc, (x.e + y.e) / 2 AS emd FROM (SELECT sc, tc FROM emd) p LEFT JOIN xe x USING (sc, tc) LEFT JOIN ye y USING (sc, tc))"""


def cutoff_sql(prefix: str, distances: str) -> str:
    """CTEs from (side, col, oside, ocol, d): each node's cutoff at the threshold 0.15, and directed edges within it."""
    return f"""
{prefix}seen AS (SELECT side, col, d AS x FROM {distances} WHERE d <= 0.15 UNION ALL SELECT side, col, 0.15 FROM nodes),
{prefix}gaps AS (SELECT side, col, x, lead(x) OVER (PARTITION BY side, col ORDER BY x) - x AS g FROM {prefix}seen),
{prefix}cut AS (SELECT n.side, n.col, coalesce(first(x ORDER BY g DESC, x), 0.0) AS c FROM nodes n LEFT JOIN (SELECT * FROM {prefix}gaps WHERE g > 0) q USING (side, col) GROUP BY ALL),
{prefix}near AS (SELECT d.* FROM {distances} d JOIN {prefix}cut USING (side, col) WHERE d <= c)"""


def components_sql(name: str, edges: str) -> str:
    """A CTE (side, col, cluster): the least node that edges (side, col, oside, ocol) reach in either direction."""
    return f"""
{name}e AS (SELECT side || col AS a, oside || ocol AS b FROM {edges} UNION SELECT oside || ocol, side || col FROM {edges}),
{name}r AS (SELECT side || col AS a, side || col AS c FROM nodes UNION SELECT e.b, r.c FROM {name}r r JOIN {name}e e ON e.a = r.a),
{name} AS (SELECT side, col, min(c) AS cluster FROM nodes JOIN {name}r r ON r.a = side || col GROUP BY ALL)"""


NODES = """nodes AS (SELECT DISTINCT 's' AS side, sc AS col FROM emd UNION SELECT DISTINCT 't', tc FROM emd),
dist AS (SELECT 's' AS side, sc AS col, 't' AS oside, tc AS ocol, emd AS d FROM emd UNION ALL SELECT 't', tc, 's', sc, emd FROM emd)"""
FIRST = f"WITH RECURSIVE {EMD_RAW}, {NODES}, {cutoff_sql('f', 'dist')}"
CLUSTERS = f"{FIRST}, {components_sql('clus', 'fnear')}"
DISTRIBUTION = f"""{CLUSTERS}, {intersection_sql()},
dist2 AS (SELECT d.* FROM (SELECT 's' AS side, sc AS col, 't' AS oside, tc AS ocol, emd AS d FROM shared UNION ALL SELECT 't', tc, 's', sc, emd FROM shared) d
  JOIN clus a ON a.side = d.side AND a.col = d.col JOIN clus b ON b.side = oside AND b.col = ocol AND a.cluster = b.cluster),
{cutoff_sql('g', 'dist2')},
reach AS (SELECT side, col, oside, ocol FROM gnear UNION SELECT a.side, a.col, b.oside, b.ocol FROM gnear a JOIN gnear b ON b.side = a.oside AND b.col = a.ocol),
{components_sql('attr', 'reach')}
SELECT 'customer' AS source_table, a.col AS source_column, 'supplier' AS target_table, b.col AS target_column, round(CASE WHEN emd IS NULL THEN 0.0 ELSE 1 / (1 + emd) END, 6) AS similarity
FROM attr a JOIN attr b ON a.cluster = b.cluster AND a.side = 's' AND b.side = 't' JOIN emd ON sc = a.col AND tc = b.col"""


def columns_sql(table: str) -> str:
    """(c, pos, label) of a table's columns, from its schema; none of its text columns is of dates."""
    named = ", ".join(f"'{c}'" for c in COLUMNS[table])
    return f"""(SELECT column_name AS c, CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'int' WHEN column_type IN ('FLOAT', 'DOUBLE') THEN 'float'
  WHEN column_type = 'DATE' THEN 'date' ELSE 'varchar' END AS label FROM (DESCRIBE {table}) WHERE column_name IN ({named}))"""


def edges_sql(table: str) -> str:
    me = f"'id:table:{table}'"
    return f"""(WITH k AS {columns_sql(table)} SELECT 'name' AS label, {me} AS src, '' AS src_name, true AS src_id, 'name:{table}' AS dst, '{table}' AS dst_name, false AS dst_id
  UNION ALL SELECT 'type', {me}, '', true, 'kind:Table', 'Table', false
  UNION ALL SELECT 'type', 'id:column:' || c, '', true, 'kind:Column', 'Column', false FROM k
  UNION ALL SELECT 'column', {me}, '', true, 'id:column:' || c, '', true FROM k
  UNION ALL SELECT 'name', 'id:column:' || c, '', true, 'name:' || c, c, false FROM k
  UNION ALL SELECT 'SQLtype', 'id:column:' || c, '', true, 'id:type:' || label, '', true FROM k
  UNION ALL SELECT DISTINCT 'type', 'id:type:' || label, '', true, 'kind:ColumnType', 'ColumnType', false FROM k
  UNION ALL SELECT DISTINCT 'name', 'id:type:' || label, '', true, 'typename:' || label, label, false FROM k)"""


GRAPHS = f"e1 AS (SELECT * FROM {edges_sql('nation')}), e2 AS (SELECT * FROM {edges_sql('region')})"
PCG = "c AS (SELECT e1.label, e1.src AS a1, e2.src AS a2, e1.dst AS b1, e2.dst AS b2 FROM e1 JOIN e2 ON e1.label = e2.label)"


def nodes_sql(e: str) -> str:
    return f"(SELECT src AS node, src_name AS name, src_id AS is_id FROM {e} UNION SELECT dst, dst_name, dst_id FROM {e})"


WEIGHTS = {
    "average": "2.0 / ((SELECT count(*) FROM e1 WHERE e1.label = c.label AND e1.src = a1) + (SELECT count(*) FROM e2 WHERE e2.label = c.label AND e2.src = a2)) AS wf, 2.0 / ((SELECT count(*) FROM e1 WHERE e1.label = c.label AND e1.dst = b1) + (SELECT count(*) FROM e2 WHERE e2.label = c.label AND e2.dst = b2)) AS wb",
    "product": "1.0 / count(*) OVER (PARTITION BY label, a1, a2) AS wf, 1.0 / count(*) OVER (PARTITION BY label, b1, b2) AS wb",
}
INITIAL = f"SELECT a.node AS n1, b.node AS n2, CASE WHEN a.is_id OR b.is_id THEN 0.0 ELSE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name), 1) END AS sim FROM {nodes_sql('e1')} a, {nodes_sql('e2')} b"
#: What a node gets in a step: from what it has (x) and began with (x0), and sums over its edges of weights times these, and of x0.
FLOWS = {"basic": "f.x + coalesce(wx, 0)", "a": "f.x0 + coalesce(wx, 0)", "b": "coalesce(w0, 0)", "c": "f.x + coalesce(s0, 0) + coalesce(wx, 0) + coalesce(w0, 0)"}


def flood_sql(formula: str, policy: str) -> str:
    """The fixpoint as a recursion of whole vectors: all steps are taken, and the vector before the first small change is the result."""

    def step(number: str, source: str, how: str) -> str:
        return f"""SELECT {number} AS step, n1, n2, x0, CASE WHEN m > 0 THEN y / m ELSE y END AS x, x AS was FROM (SELECT *, max(y) OVER () AS m FROM (
    SELECT f.step, f.n1, f.n2, f.x0, f.x, CASE WHEN i.n1 IS NULL THEN 0.0 ELSE {how} END AS y FROM {source} f LEFT JOIN inside i ON i.n1 = f.n1 AND i.n2 = f.n2
    LEFT JOIN (SELECT v1, v2, sum(weight * x) AS wx, sum(weight * x0) AS w0, sum(x0) AS s0 FROM {source} g JOIN link ON u1 = g.n1 AND u2 = g.n2 GROUP BY v1, v2) a ON a.v1 = f.n1 AND a.v2 = f.n2))"""

    first = formula in ("b", "c")
    steps = 99 if first else 100
    return f"""WITH RECURSIVE {GRAPHS}, {PCG}, w AS (SELECT *, {WEIGHTS[policy]} FROM c),
link AS (SELECT u1, u2, v1, v2, max(weight) AS weight FROM (SELECT a1 AS u1, a2 AS u2, b1 AS v1, b2 AS v2, CAST(wf AS DOUBLE) AS weight FROM w UNION ALL SELECT b1, b2, a1, a2, CAST(wb AS DOUBLE) FROM w) GROUP BY ALL),
inside AS (SELECT u1 AS n1, u2 AS n2 FROM link UNION SELECT v1, v2 FROM link),
start AS (SELECT 0 AS step, n1, n2, CAST(sim AS DOUBLE) AS x0, CAST(sim AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS was FROM ({INITIAL})),
begin_ AS ({step('0', 'start', FLOWS['b']) if first else 'SELECT * FROM start'}),
flow AS (SELECT step, n1, n2, x0, x, CAST(NULL AS DOUBLE) AS was FROM begin_ UNION ALL SELECT * FROM ({step('step + 1', 'flow', FLOWS[formula])}) WHERE step <= {steps}),
ends AS (SELECT coalesce(min(step) - 1, {steps}) AS e FROM (SELECT step, sqrt(sum((x - was) * (x - was))) AS r FROM flow WHERE step > 0 GROUP BY step) WHERE r <= 0.0001)
SELECT 'nation' AS source_table, substr(n1, 11) AS source_column, 'region' AS target_table, substr(n2, 11) AS target_column, round(x, 6) AS similarity FROM flow JOIN ends ON step = e WHERE n1 LIKE 'id:column:%' AND n2 LIKE 'id:column:%'"""


#: Those of the common words that a column of these tables could be named with.
COMMON = "('a', 'i', 's', 't', 'the', 'of', 'and', 'in')"


def cupid_sql() -> str:
    kinds = "CASE kind WHEN 'content' THEN 0.8 ELSE 0.1 END"
    return f"""WITH cols AS (SELECT 's' AS side, * FROM {columns_sql('customer')} UNION ALL SELECT 't', * FROM {columns_sql('supplier')}),
words AS (SELECT side, c, unnest(list_filter(string_split_regex(replace(lower(regexp_replace(regexp_replace(c, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_', ' '), '[^a-z0-9.]+'), lambda x: x <> '')) AS d FROM cols),
tok AS (SELECT side, c, d, CASE WHEN TRY_CAST(d AS DOUBLE) IS NOT NULL THEN 'number' WHEN d IN {COMMON} THEN 'common' ELSE 'content' END AS kind FROM words),
pairs AS (SELECT a.c AS sc, b.c AS tc, a.label AS sl, b.label AS tl FROM cols a, cols b WHERE a.side = 's' AND b.side = 't'),
sims AS (SELECT sc, tc, a.kind, a.d AS x, b.d AS y, CASE WHEN a.d = b.d THEN 1.0 ELSE 1 - levenshtein(a.d, b.d) / greatest(length(a.d), length(b.d), 1) END AS v FROM pairs JOIN tok a ON a.side = 's' AND a.c = sc JOIN tok b ON b.side = 't' AND b.c = tc AND a.kind = b.kind),
best AS (SELECT sc, tc, kind, max(v) AS v FROM sims GROUP BY sc, tc, kind, x UNION ALL SELECT sc, tc, kind, max(v) FROM sims GROUP BY sc, tc, kind, y),
kinds AS (SELECT sc, tc, kind, sum(v) / count(*) AS one FROM best GROUP BY ALL),
names AS (SELECT sc, tc, sum(one * {kinds}) / sum({kinds}) AS v FROM kinds GROUP BY ALL),
compat AS (SELECT *, CASE WHEN sl = tl THEN 1.0 WHEN (sl, tl) IN (('varchar', 'int'), ('int', 'varchar'), ('date', 'int'), ('int', 'date')) THEN 0.1 ELSE 1 - levenshtein(sl, tl) / greatest(length(sl), length(tl), 1) END AS k FROM pairs),
scored AS (SELECT sc, tc, k * 0.2 + CASE WHEN k > 0.7 THEN coalesce(v, 0) * k ELSE 0 END * 0.8 AS s FROM compat LEFT JOIN names USING (sc, tc))
SELECT 'customer' AS source_table, sc AS source_column, 'supplier' AS target_table, tc AS target_column, round(CAST(s AS DOUBLE), 6) AS similarity FROM scored WHERE s >= 0.7"""


def composite_sql(instances: bool) -> str:
    """The mean of name and path trigrams, name tokens, types, and with instances the cosine of value tokens' weights."""
    grams = lambda x: f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substr('  ' || lower({x}) || '  ', i, 3)))"
    dice = lambda a, b: f"2.0 * len(list_intersect({grams(a)}, {grams(b)})) / (len({grams(a)}) + len({grams(b)}))"
    names = cupid_sql().split(",\nscored AS")[0]
    values = f""",
cell AS ({cells_sql('customer', 'supplier')}),
bag AS (SELECT tbl, col, token, count(*) AS tf FROM (SELECT tbl, col, unnest(list_distinct(list_filter(string_split_regex(lower(v), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS token FROM cell) GROUP BY ALL),
idf AS (SELECT token, ln(((SELECT count(*) FROM (SELECT DISTINCT tbl, col FROM bag)) + 1) / (count(*) + 1)) + 1 AS idf FROM bag GROUP BY token),
weight AS (SELECT tbl, col, token, (1 + ln(tf)) * idf AS x FROM bag JOIN idf USING (token)),
unit AS (SELECT tbl, col, token, x / sqrt(sum(x * x) OVER (PARTITION BY tbl, col)) AS x FROM weight),
cosine AS (SELECT a.col AS sc, b.col AS tc, sum(a.x * b.x) AS cosine FROM unit a JOIN unit b ON a.token = b.token AND a.tbl = 'customer' AND b.tbl = 'supplier' GROUP BY ALL)"""
    extra, join, n = (" + coalesce(cosine, 0.0)", " LEFT JOIN cosine USING (sc, tc)", 5) if instances else ("", "", 4)
    path = dice("('customer ' || sc)", "('supplier ' || tc)")
    return f"""{names}{values if instances else ''},
total AS (SELECT sc, tc, ({dice('sc', 'tc')} + coalesce(v, 0.0) + k + {path}{extra}) / {n} AS s FROM compat LEFT JOIN names USING (sc, tc){join})
SELECT 'customer' AS source_table, sc AS source_column, 'supplier' AS target_table, tc AS target_column, round(CAST(s AS DOUBLE), 6) AS similarity FROM total WHERE s >= 0.4"""


FIXTURE = "m AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}', {x})" for i, (a, b, c, d, x) in enumerate(ROWS)) + ") AS v(pos, source_table, source_column, target_table, target_column, similarity))"
PLACES = ", ".join(f"('{c}', {i})" for t in ("customer", "supplier") for i, c in enumerate(COLUMNS[t]))
REAL = f"""p AS (SELECT * FROM (VALUES {PLACES}) AS v(col, place)), j AS ({jaccard_sql("{a} = {b}", ("customer",), ("supplier",)).replace("round(h / (a + b - h), 6)", "h / (a + b - h)")}),
m AS (SELECT row_number() OVER (ORDER BY similarity DESC, x.place, y.place) AS pos, j.* FROM j JOIN p x ON x.col = source_column JOIN p y ON y.col = target_column)"""
#: From m, in order of similarity and pos: the best ones, each column at most once and none below the median of the distinct scores.
GREEDY = """d AS (SELECT similarity AS x, row_number() OVER (ORDER BY similarity DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT similarity FROM m)),
good AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, pos) AS rn, 's.' || source_table || '.' || source_column AS u, 't.' || target_table || '.' || target_column AS v FROM m WHERE similarity >= (SELECT min(x) FROM d WHERE r = least(ceil(n / 2) + 1, n))),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS used, false AS ok UNION ALL
  SELECT good.rn, CASE WHEN list_contains(used, u) OR list_contains(used, v) THEN used ELSE list_concat(used, [u, v]) END, NOT (list_contains(used, u) OR list_contains(used, v)) FROM walk JOIN good ON good.rn = walk.rn + 1),
one AS (SELECT good.* FROM good JOIN walk ON good.rn = walk.rn WHERE ok OR (SELECT count(*) FROM d) < 2)"""


def metrics_sql(relation: str, truth, asked: list[tuple[str, str, str, str]]) -> str:
    """Rows (metric, value) for (metric, relation, how many of its best rows count, measure), each from counts of these rows."""
    t = ", ".join(f"('{a}', '{b}')" for a, b in truth)
    measures = {"precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(n, 0)", "f1": "2 * tp / nullif(tp + fp + n, 0)"}
    parts = []
    for name, rel, n, measure in asked:
        best = f"(SELECT source_column AS a, target_column AS b FROM {rel} QUALIFY row_number() OVER (ORDER BY similarity DESC, pos) <= {n})"
        tp = f"(SELECT count(*) FROM truth SEMI JOIN {best} USING (a, b))"
        fp = f"(SELECT count(*) FROM {best} x ANTI JOIN truth USING (a, b))"
        parts.append(f"SELECT '{name}' AS metric, round(coalesce({measures[measure]}, 0.0), 6) AS value FROM (SELECT CAST({tp} AS DOUBLE) AS tp, {fp} AS fp, (SELECT count(*) FROM truth) AS n)")
    return f"WITH RECURSIVE {relation}, {GREEDY}, truth AS (SELECT * FROM (VALUES {t}) AS v(a, b)) " + " UNION ALL ".join(parts)


def top(rel: str, percent: float) -> str:
    return f"(SELECT ceil({percent} / 100 * count(*)) FROM {rel})"


EVERY = "9e9"
ASKED = [x for rel, tag in (("one", "1to1"), ("m", "all")) for x in ((f"Precision_{tag}", rel, EVERY, "precision"), (f"Recall_{tag}", rel, EVERY, "recall"), (f"F1Score_{tag}", rel, EVERY, "f1"), (f"PrecisionTop50Percent_{tag}", rel, top(rel, 50.0), "precision"), (f"PrecisionTop70Percent_{tag}", rel, top(rel, 70.0), "precision"))]
ASKED_CORE = [("Precision", "one", EVERY, "precision"), ("Recall", "one", EVERY, "recall"), ("F1Score", "one", EVERY, "f1"), ("PrecisionTop10Percent", "one", top("one", 10.0), "precision")]
OUT = "source_table, source_column, target_table, target_column, round(CAST(similarity AS DOUBLE), 6) AS similarity"

ORACLES = {
    "column_profile": f'SELECT tbl AS "table", col AS "column", count(*) AS rows, count(DISTINCT v) AS "distinct" FROM ({cells_sql("customer", "supplier")}) GROUP BY ALL',
    "jaccard_exact": jaccard_sql("{a} = {b}", ("customer",), ("supplier",)),
    "jaccard_levenshtein": jaccard_sql(EDIT.format(d="levenshtein"), ("customer",), ("supplier",)),
    "jaccard_damerau": jaccard_sql(EDIT.format(d="damerau_levenshtein"), ("customer",), ("supplier",)),
    "jaccard_hamming": jaccard_sql(HAMMING, ("customer",), ("supplier",)),
    "jaccard_jaro": jaccard_sql("jaro_similarity({a}, {b}) >= 0.8", ("supplier",), ("nation",)),
    "jaccard_jaro_winkler": jaccard_sql("jaro_winkler_similarity({a}, {b}) >= 0.8", ("supplier",), ("nation",)),
    "jaccard_batch": jaccard_sql("{a} = {b}", ("customer", "nation"), ("supplier", "region")),
    "global_rank": f"SELECT v AS value, {RANKED} AS rank FROM (SELECT DISTINCT v FROM ({cells_sql('nation', 'region', 'supplier')}))",
    "quantile_histogram": f'WITH {RANKS} SELECT tbl AS "table", col AS "column", low, CAST(len(b) AS INTEGER) AS n_bounds, round(list_sum(b), 2) AS sum_bounds FROM bounds',
    "quantile_emd": f"WITH {EMD_RAW} SELECT sc, tc, round(coalesce(emd, -1.0), 6) AS emd FROM emd",
    "intersection_emd": f"WITH {EMD_RAW}, {intersection_sql()} SELECT sc, tc, round(coalesce(emd, -1.0), 6) AS emd FROM shared",
    "dist_cutoff": f"{FIRST} SELECT side, col, round(c, 6) AS cutoff FROM fcut",
    "dist_clusters": f"{CLUSTERS} SELECT side, col, cluster FROM clus",
    "distribution_match": DISTRIBUTION,
    "cupid_leaf": cupid_sql(),
    "composite_match": composite_sql(False),
    "composite_instances": composite_sql(True),
    **{f"flood_match_{f}_{p}": flood_sql(f, p) for f in FLOWS for p in WEIGHTS},
    "flood_initial_map": f"WITH {GRAPHS} SELECT n1, n2, round(CAST(sim AS DOUBLE), 6) AS sim FROM ({INITIAL})",
    "flood_connectivity": f"WITH {GRAPHS}, {PCG} SELECT * FROM c",
    **{f"flood_weights_{k}": f"WITH {GRAPHS}, {PCG}, w AS (SELECT *, {v} FROM c) SELECT a1 AS u1, a2 AS u2, b1 AS v1, b2 AS v2, round(CAST(wf AS DOUBLE), 6) AS weight FROM w UNION ALL SELECT b1, b2, a1, a2, round(CAST(wb AS DOUBLE), 6) FROM w" for k, v in WEIGHTS.items()},
    "top_n": f"WITH {FIXTURE} SELECT {OUT} FROM m ORDER BY m.similarity DESC, pos LIMIT 2",
    "top_percent": f"WITH {FIXTURE} SELECT {OUT} FROM m QUALIFY row_number() OVER (ORDER BY m.similarity DESC, pos) <= ceil(0.4 * count(*) OVER ())",
    "one_to_one": f"WITH RECURSIVE {FIXTURE}, {GREEDY} SELECT {OUT} FROM one",
    "one_to_one_tables": f"WITH RECURSIVE {REAL}, {GREEDY} SELECT {OUT} FROM one",
    "top_n_tables": f"WITH {REAL} SELECT {OUT} FROM m QUALIFY row_number() OVER (ORDER BY m.similarity DESC, pos) <= 3",
    "match_metrics": metrics_sql(FIXTURE, TRUTH, [*ASKED, ("RecallAtSizeofGroundTruth", "m", str(len(TRUTH)), "recall")]),
    "get_metrics": metrics_sql(REAL, REAL_TRUTH, [*ASKED_CORE, ("RecallAtSizeofGroundTruth", "m", str(len(REAL_TRUTH)), "recall")]),
}
