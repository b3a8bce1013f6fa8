"""DuckDB SQL of the queries that SQL can express."""

from riskweave.llm import urls

#: Segments that the SQL of op5 reads; the operator reads all.
LEVELS = 6


def _url_sql() -> str:
    hosts = {(h, p): v for v, h, p in urls.RULES}
    ordered = sorted(hosts, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p in ordered) + " END"
    by_rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{hosts[h, p]}'" for h, p in ordered) + " END"
    levels = []
    for k in range(1, LEVELS + 1):
        levels.append(f"""
        c{k} AS (SELECT *, segs[{k + 1}] AS child FROM t{k - 1} WHERE len(segs) > {k}),
        k{k} AS (SELECT host, node, child, sum(n) AS c_n, sum(lab) AS c_lab, sum(bad) AS c_bad FROM c{k} GROUP BY ALL),
        p{k} AS (SELECT host, node, sum(c_lab) AS p_lab, sum(c_bad) AS p_bad, count(*) FILTER (c_n <= {urls.RARE}) >= {urls.MANY} AS varies FROM k{k} GROUP BY ALL),
        f{k} AS (SELECT host, node, child, varies AND c_n <= {urls.RARE} AS rare,
                        NOT (varies AND c_n <= {urls.RARE}) AND c_lab > 0 AND pow((c_bad * p_lab - p_bad * c_lab)::DOUBLE, 2) <= (4 * p_bad * (p_lab - p_bad) * c_lab)::DOUBLE AS alike
                 FROM k{k} JOIN p{k} USING (host, node)),
        s{k} AS (SELECT host, node, child, CASE WHEN rare OR (alike AND count(*) FILTER (alike) OVER (PARTITION BY host, node) > 1) THEN '*' ELSE child END AS "to" FROM f{k}),
        t{k} AS (SELECT c.host, shape, n, lab, bad, segs, c.node || '/' || "to" AS node FROM c{k} c JOIN s{k} s ON c.host = s.host AND c.node = s.node AND c.child = s.child)""")
    ended = " UNION ALL ".join([f"SELECT host, shape, lab, bad, node FROM t{k} WHERE len(segs) <= {k + 1}" for k in range(LEVELS)] + [f"SELECT host, shape, lab, bad, node FROM t{LEVELS}"])
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    seen AS (SELECT *, {rule} AS rule, {by_rule} AS by_rule,
                    regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-f]{{8,}}', '{{x}}', 'g'), '[A-Za-z0-9_-]{{24,}}', '{{s}}', 'g'), '[0-9]+', '{{n}}', 'g') AS shape
             FROM parts),
    marks AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS is_bad FROM labels
              WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
    marked AS (SELECT host, shape, CASE WHEN is_bad IS NULL THEN 0 ELSE 1 END AS labelled, coalesce(is_bad, 0) AS bad FROM seen LEFT JOIN marks USING (page_id)),
    t0 AS (SELECT host, shape, count(*) AS n, sum(labelled) AS lab, sum(bad) AS bad, string_split(shape, '/') AS segs, '' AS node FROM marked GROUP BY host, shape),
    {",".join(levels)},
    ended AS ({ended}),
    counts AS (SELECT host, node, sum(lab) AS t_lab, sum(bad) AS t_bad FROM ended GROUP BY ALL),
    prior AS (SELECT coalesce(sum(bad), 0)::DOUBLE / (coalesce(sum(labelled), 0) + {urls.PRIOR}) AS p FROM marked),
    hosts AS (SELECT host, (sum(bad) + {urls.PRIOR} * any_value(p)) / (sum(labelled) + {urls.PRIOR}) AS own FROM marked, prior GROUP BY host)
    SELECT s.page_id, s.host, s.path, s.rule, t.node AS template,
           coalesce(s.by_rule, CASE WHEN (c.t_bad + {urls.PRIOR} * h.own) / (c.t_lab + {urls.PRIOR}) >= {urls.PURITY} THEN 'block' ELSE 'allow' END) AS verdict
    FROM seen s JOIN ended t ON s.host = t.host AND s.shape = t.shape JOIN counts c ON t.host = c.host AND t.node = c.node JOIN hosts h ON h.host = s.host
    """


ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a
    """,
    "op3_minhash_near_dedup": """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
    x AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.sh) + len(q.sh) - n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON doc_id = a
    """,
    "op5_url_filter": _url_sql(),
    "op8_exact_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op9_substring_dedup": """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
    low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
    hit AS (SELECT doc_id, i FROM win JOIN low USING (g) WHERE low.d < doc_id),
    gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places FROM hit GROUP BY doc_id),
    kept AS (SELECT doc_id, ws, list_filter(ws, lambda x, k: NOT list_contains(coalesce(places, []), k)) AS ks FROM w LEFT JOIN gone USING (doc_id))
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(ks))::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
    """,
}
