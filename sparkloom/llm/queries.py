"""The registered queries of this subpackage: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, line_dedup, mixing, neighbours, ngram_join, token_output, toxicity, url_filter
from .store import read

#: host, path, allowed
URL_RULES = [
    url_filter.Rule("com", "/en/", False),
    url_filter.Rule("example.com", "/en/7", True),
    url_filter.Rule("net", "/de/", True),
    url_filter.Rule("example.net", "/de/8", False),
    url_filter.Rule("org", "/es/", False),
]


#: Largest flattening under which no source is repeated more than this often while none is cut.
MIX_REPEATS = 1.5
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), entropy=0.97)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _url_sql(order: int = 3, rare: float = 0.0, width: float = 0.01) -> str:
    """The URL filter as SQL: rules, counts, interpolated models by order, scores, threshold."""
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in sorted(URL_RULES, key=lambda r: (-len(r.text), -len(r.host)))}
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in fits.items()) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN {str(r.allow).lower()}" for r, f in fits.items()) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = lambda c: f"regexp_replace(regexp_replace({lower.format(c)}, '[0-9]', '0', 'g'), '[^a-z0./_-]', '~', 'g')"
    seeds = [(x, "true") for x in url_filter.ACCEPTED_SEEDS] + [(x, "false") for x in url_filter.REJECTED_SEEDS]
    size, start = len(url_filter.ALPHABET), url_filter.START * order
    parts = [
        "x AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"y AS (SELECT page_id, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x)",
        f"b AS (SELECT *, {rule} AS rule, {ruled} AS ruled, {plain('host || path')} AS s FROM y)",
        "known AS (SELECT s, ruled AS allow, CAST(count(*) AS DOUBLE) AS n FROM b WHERE ruled IS NOT NULL GROUP BY ALL)",
        f"seeds AS (SELECT {plain('t')} AS s, allow, (SELECT greatest(1.0, coalesce(sum(n), 0.0) / {len(seeds)}) FROM known) AS n FROM (VALUES {', '.join(f"('{t}', {a})" for t, a in seeds)}) v(t, allow))",
        "lab AS (SELECT s, allow, sum(n) AS n FROM (SELECT * FROM known UNION ALL SELECT * FROM seeds) WHERE length(s) > 0 GROUP BY ALL)",
        f"pos AS (SELECT allow, n, substr('{start}' || s, CAST(i AS INT), {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM lab))",
        "c AS (SELECT gram, coalesce(sum(n) FILTER (WHERE allow), 0.0) AS a, coalesce(sum(n) FILTER (WHERE NOT allow), 0.0) AS r FROM pos GROUP BY gram)",
        f"symbols AS (SELECT unnest(string_split('{url_filter.ALPHABET}', '')) AS ch)",
    ]
    for k in range(order + 1):
        parts.append(f"v{k} AS (SELECT substr(gram, {order + 1 - k}, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1)")
        parts.append(f"w{k} AS (SELECT substr(gram, 1, {k}) AS ctx, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM v{k} GROUP BY 1)")
        parts.append(f"t{k} AS (SELECT w.*, ctx || ch AS gram, coalesce(v.a, 0.0) AS a, coalesce(v.r, 0.0) AS r FROM w{k} w JOIN symbols ON na + nr >= (SELECT sum(a + r) FROM v{k}) * {rare!r} LEFT JOIN v{k} v ON v.gram = ctx || ch)")
        if k == 0:
            parts.append(f"m0 AS (SELECT gram, (a + 0.5) / (na + 0.5 * {size}) AS pa, (r + 0.5) / (nr + 0.5 * {size}) AS pr FROM t0)")
        else:
            mixed = lambda n, total, types, low: f"CASE WHEN {total} > 0 THEN ({n} + {types} * {low}) / ({total} + {types}) ELSE {low} END"
            parts.append(f"m{k} AS (SELECT t.gram, {mixed('a', 'na', 'ta', 'm.pa')} AS pa, {mixed('r', 'nr', 'tr', 'm.pr')} AS pr FROM t{k} t JOIN m{k - 1} m ON m.gram = substr(t.gram, 2))")
    best = ", ".join(f"ln(m{k}.pa / m{k}.pr)" for k in range(order, -1, -1))
    joins = " ".join(f"LEFT JOIN m{k} ON m{k}.gram = substr(g, {order + 1 - k}, {k + 1})" for k in range(order + 1))
    parts += [
        f"q AS (SELECT s, substr('{start}' || s, CAST(i AS INT), {order + 1}) AS g FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT DISTINCT s FROM b WHERE length(s) > 0)))",
        f"sc AS (SELECT s, avg(coalesce({best}, 0.0)) AS score FROM q {joins} GROUP BY s)",
        f"bins AS (SELECT CAST(greatest(-1000, least(1000, floor(score / {width}))) AS INT) AS bin, count(*) FILTER (WHERE allow) AS a, count(*) FILTER (WHERE NOT allow) AS r FROM known JOIN sc USING (s) GROUP BY 1)",
        "sums AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS under, coalesce(sum(a) OVER below, 0) / greatest(sum(a) OVER (), 1) + (sum(r) OVER () - coalesce(sum(r) OVER below, 0)) / greatest(sum(r) OVER (), 1) AS error, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"lim AS (SELECT coalesce((SELECT CASE WHEN na = 0 OR nr = 0 THEN 0.0 ELSE (bin + coalesce(under + 1, bin)) / 2 * {width} END FROM sums WHERE error <= (SELECT min(error) FROM sums) + 0.01 ORDER BY bin LIMIT 1), 0.0) AS l)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, CASE WHEN coalesce(ruled, coalesce(score >= l, true)) THEN 'allow' ELSE 'block' END AS verdict FROM b LEFT JOIN sc USING (s), lim"


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join("dropped", ","))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_filters": op7_url_filters,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_output": op9_token_output,
    "op10_html_extraction": op10_html_extraction,
}

_GOOD = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SUM = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, x: s + x)"

ORACLE_SQL: dict[str, str] = {
    "op7_url_filters": _url_sql(),
    "op2_nearest_neighbours": f"""WITH v AS ({_GOOD}), n AS (SELECT vec_id, e, sqrt({_SUM.format(a="e", b="e")}) AS l FROM v), p AS (
SELECT q.vec_id AS query_id, c.vec_id, {_SUM.format(a="q.e", b="c.e")} / (q.l * c.l) AS score FROM n q JOIN n c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op6_ngram_jaccard_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.v, root FROM r JOIN e ON e.u = r.doc_id WHERE root < e.v),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_line_dedup": """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
o AS (SELECT doc_id, unnest(range(len(raw))) AS line_no, unnest(raw) AS raw FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, line_no, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS w FROM o),
f AS (SELECT w, min((doc_id, line_no)) AS f FROM l WHERE len(w) > 0 GROUP BY w),
i AS (SELECT w, f, len(w) AS n, unnest(range(len(w) + 1)) AS i FROM f),
k AS (SELECT w, f, n, n AS m, i, array_to_string(w[1:i], ' ') || chr(1) || array_to_string(w[i + 1:], ' ') AS t FROM i UNION ALL SELECT w, f, n, n - 1, i, array_to_string(w[1:i], ' ') || chr(1) || array_to_string(w[i + 2:], ' ') FROM i WHERE i < n),
g AS (SELECT m, i, t, min(f) AS first FROM k WHERE n >= 5 GROUP BY m, i, t),
e AS (SELECT DISTINCT w FROM k JOIN g USING (m, i, t) WHERE first < f AND n >= 5),
x AS (SELECT l.doc_id, l.line_no FROM l JOIN f USING (w) LEFT JOIN e ON e.w = l.w WHERE e.w IS NOT NULL OR f.f < (l.doc_id, l.line_no)),
y AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM x GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS INT) AS n_lines, CAST(coalesce(n, 0) AS INT) AS n_dropped, coalesce(dropped, '') AS dropped FROM d LEFT JOIN y USING (doc_id)""",
}
