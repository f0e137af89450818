"""SQL counterparts of the operators' queries."""

from panelweave.llm.license_scan import CUE, LICENCE_FILE, TEMPLATES, TOKEN
from panelweave.llm.license_scan import THRESHOLD as LICENSE_THRESHOLD
from panelweave.llm.queries import URL_RULES
from panelweave.llm.url_trust import DAMPING, HOST, ITERATIONS, LINK, LOWER, PATH, THRESHOLD, UNIT, UPPER

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS i FROM s
), l AS (
  SELECT i, w, source_size,
         (1.5 * CAST((SELECT sum(size) FROM d) AS DOUBLE)
          - coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), f AS (
  SELECT min_by(level, i) AS level FROM l WHERE level * w <= 2 * source_size
), t AS (
  SELECT source, source_size, least(coalesce(w * (SELECT level FROM f), 2.0 * source_size), CAST(2 * source_size AS DOUBLE)) AS target FROM s
), p AS (
  SELECT d.doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) AS BIGINT) AS taken
FROM p
"""

OP8 = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""



def _op1() -> str:
    """The same rounds of whole-number mass, one common table expression each."""
    rules = sorted(URL_RULES, key=lambda r: (-len(r.text), -len(r.host), r))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, rules, strict=True)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules, strict=True)) + " END"
    host = lambda url: f"translate(regexp_extract(coalesce({url}, ''), '{HOST}', 1), '{UPPER}', '{LOWER}')"
    rounds = ", ".join(
        f"""m{i + 1} AS MATERIALIZED (
          SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
            SELECT kind, host, CAST(floor(mass * CAST({1 - DAMPING!r} AS DOUBLE)) AS BIGINT) AS mass FROM m0
            UNION ALL
            SELECT ways.kind, b, CAST(floor(m{i}.mass * weight) AS BIGINT) FROM ways JOIN m{i} ON ways.kind = m{i}.kind AND ways.a = m{i}.host
          ) GROUP BY kind, host)"""
        for i in range(ITERATIONS)
    )
    return f"""
    WITH p AS MATERIALIZED (
      SELECT page_id, html, {host("url")} AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages
    ), j AS MATERIALIZED (SELECT *, {rule} AS rule, {ruled} AS ruled FROM p),
    seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM j WHERE host <> '' GROUP BY host),
    links AS (SELECT host AS a, {host("link")} AS b FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK}', 1)) AS link FROM p WHERE host <> '')),
    edges AS (SELECT a, b, count(*) AS n FROM links WHERE b <> '' AND a <> b GROUP BY a, b),
    both_ways AS (SELECT 'trust' AS kind, a, b, n FROM edges UNION ALL SELECT 'distrust', b, a, n FROM edges),
    ways AS MATERIALIZED (
      SELECT kind, a, b, CAST({DAMPING!r} AS DOUBLE) * n / CAST(sum(n) OVER (PARTITION BY kind, a) AS DOUBLE) AS weight FROM both_ways),
    m0 AS MATERIALIZED (SELECT * FROM (
      SELECT 'trust' AS kind, host, CAST(floor(CAST({UNIT} AS DOUBLE) * allow / greatest((SELECT sum(allow) FROM seeds), 1)) AS BIGINT) AS mass FROM seeds
      UNION ALL
      SELECT 'distrust', host, CAST(floor(CAST({UNIT} AS DOUBLE) * block / greatest((SELECT sum(block) FROM seeds), 1)) AS BIGINT) FROM seeds
    ) WHERE mass > 0), {rounds},
    scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS d FROM m{ITERATIONS} GROUP BY host)
    SELECT page_id, j.host, path, rule,
           coalesce(ruled, CASE WHEN d > 0 AND d >= {THRESHOLD} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(coalesce(t, 0) AS BIGINT) AS host_trust, CAST(coalesce(d, 0) AS BIGINT) AS host_distrust
    FROM j LEFT JOIN scores ON j.host = scores.host
    """


OP2 = """
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) AS size, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM u x JOIN u y ON x.label = y.label AND x.size = y.size AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), heads AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN heads ON vec_id = heads.a LEFT JOIN counts ON vec_id = counts.a
"""

OP9 = """
WITH h AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS head,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d
"""



def _op3() -> str:
    templates = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    best = "min(struct_pack(score := -score, license := license))"
    weighted = lambda name, source: f"""
    {name}_tf AS (SELECT unit, token, count(*) AS tf FROM (SELECT unit, unnest(words) AS token FROM {source}) GROUP BY unit, token),
    {name}_w AS (SELECT unit, token, tf * (ln(CAST(1 + total AS DOUBLE) / (1 + df)) + 1) AS raw FROM {name}_tf JOIN df USING (token), totals),
    {name}_n AS (SELECT unit, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY unit)) AS weight FROM {name}_w)"""  # noqa: E731
    unit, template = weighted("u", "units").split(",\n", 1), weighted("t", "kinds").split(",\n", 1)
    return f"""
    WITH files AS (
      SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR),
        CASE WHEN doc_id % 10 = 0 THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END) AS path FROM documents
    ), f AS (
      SELECT *, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}') AS is_license, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files
    ), parts AS (
      SELECT doc_id, path, unnest(list_distinct(list_concat(
          list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '{CUE}')),
          list_filter(regexp_split_to_array(text, '\\r?\\n[ \\t]*\\r?\\n'), lambda x: regexp_matches(x, '{CUE}')),
          CASE WHEN is_license THEN [text] ELSE [] END))) AS part
      FROM f WHERE regexp_matches(text, '{CUE}') OR is_license
    ), cut AS (SELECT DISTINCT doc_id, path, regexp_extract_all(lower(part), '{TOKEN}') AS unit FROM parts),
    units AS (SELECT DISTINCT unit, unit AS words FROM cut WHERE len(unit) > 0),
    kinds AS (SELECT unit, license, regexp_extract_all(lower(t), '{TOKEN}') AS words FROM (VALUES {templates}) k(unit, license, t)),
    totals AS (SELECT (SELECT count(*) FROM units) + (SELECT count(*) FROM kinds) AS total),
    {unit[0]}, {template[0]},
    df AS (SELECT token, count(*) AS df FROM (SELECT token FROM u_tf UNION ALL SELECT token FROM t_tf) GROUP BY token),
    {unit[1]}, {template[1]},
    scores AS (
      SELECT u.unit, license, round(sum(u.weight * t.weight), 6) AS score
      FROM u_n u JOIN t_n t USING (token) JOIN kinds ON kinds.unit = t.unit GROUP BY u.unit, t.unit, license
    ), matched AS (SELECT unit, {best} AS best FROM scores WHERE score >= {LICENSE_THRESHOLD} GROUP BY unit),
    owned AS (SELECT doc_id, path, min(best) AS best FROM cut JOIN matched USING (unit) GROUP BY doc_id, path),
    with_own AS (SELECT f.doc_id, f.path, dir, is_license, best FROM f LEFT JOIN owned USING (doc_id, path)),
    by_dir AS (SELECT dir AS license_dir, min(best) AS best FROM with_own WHERE is_license AND best IS NOT NULL GROUP BY dir),
    near AS (
      SELECT doc_id, w.path, max_by(license_dir, length(license_dir)) AS license_dir, max_by(d.best, length(license_dir)) AS best
      FROM with_own w JOIN by_dir d ON w.dir = license_dir OR starts_with(w.dir, concat(license_dir, '/')) OR license_dir = ''
      WHERE w.best IS NULL GROUP BY doc_id, w.path
    )
    SELECT w.doc_id, w.path, coalesce(w.best.license, near.best.license) AS license,
           CASE WHEN w.best IS NOT NULL THEN 'own' WHEN near.best IS NOT NULL THEN 'inherited' END AS origin,
           -coalesce(w.best.score, near.best.score) AS score, near.license_dir
    FROM with_own w LEFT JOIN near USING (doc_id, path)
    """


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as two expressions: all entries compared, then the floors of the means."""
    floor_mean = "(s - (((s % n) + n) % n)) // n"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""g{i} AS MATERIALIZED (
  SELECT row, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
  FROM (SELECT x.row, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM x JOIN b{i} b ON x.p = b.p) GROUP BY row, p
)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM b{i} b LEFT JOIN (
    SELECT p, e, list(CAST({floor_mean} AS BIGINT) ORDER BY pos) AS c
    FROM (SELECT p, e, pos, sum(v) AS s, count(*) AS n
          FROM (SELECT g.p, g.e, unnest(x.c) AS v, generate_subscripts(x.c, 1) AS pos FROM g{i} g JOIN x ON g.row = x.row AND g.p = x.p)
          GROUP BY p, e, pos)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), x AS MATERIALIZED (
  SELECT row, p, c[p * (len(c) // {parts}) + 1 : (p + 1) * (len(c) // {parts})] AS c FROM v, range({parts}) r(p)
), b0 AS (
  SELECT p, row - 1 AS e, c FROM x WHERE row <= {entries}
), {", ".join(steps)}, k AS (
  SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM g{rounds} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN v USING (row)
"""


OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 100 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN w.doc_id > first_id THEN 'E' END) AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), n AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT part, filter_order, n, good, toxic, failed, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f,
         coalesce(list_min(list_transform(string_split(failed, ''), lambda x: CASE WHEN x <> '' THEN instr(filter_order, x) END)), 6) AS gone
  FROM n, o, range(1, 6) r(step)
), c AS (
  SELECT part, filter_order, step, f,
         CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN contains(failed, f) AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM c
"""

ORACLES = {
    "op1_url_verdicts": _op1(),
    "op2_near_vectors": OP2,
    "op3_license_scan": _op3(),
    "op5_source_mix": OP5,
    "op8_exact_dedup": OP8,
    "op9_archives": OP9,
    "op12_vector_codes": _op12(),
    "op13_filter_audit": OP13,
}
