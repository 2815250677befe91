"""SQL of the queries in ``extra``."""

from __future__ import annotations

from sparkloom import bindings as B
from sparkloom.queries.graphs import _G, _RESOLVE, ORACLES as _GRAPHS

_ROLE = "CASE WHEN is_test THEN 'test' WHEN is_entry THEN 'entry' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' ELSE 'module' END"
_ORPHAN = "fan_in = 0 AND NOT is_entry AND NOT is_test"


ORACLES = {
    "contain_path": "WITH " + B.FILES + "SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN NULL WHEN doc_id % 4 = 1 THEN path ELSE 'src/' || path END AS path FROM files",
    "limit_clamp": "SELECT p_partkey, greatest(1, least(CASE WHEN p_size <> 7 THEN p_size * 10 - 50 ELSE 20 END, 200))::BIGINT AS most FROM part",
    "join_dir_suffix": "WITH " + B.FILES + """, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files), p AS (SELECT dir, string_split(dir, '/') AS a FROM d),
        s AS (SELECT dir, array_to_string(a[len(a) - k + 1:], '/') AS suffix FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= len(a)) SELECT suffix, min(dir) AS dir, count(*) AS n FROM s GROUP BY 1""",
    "repo_names": r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/:]+)/*$', 1), '\.git$', '') AS name, regexp_replace(regexp_extract(url, '^(?:https?://|git@)[^/:]+[/:]([^/?#]+/[^/?#]+)', 1), '\.git$', '') AS path FROM pages",
    "v_explain_file": _G() + f""", b AS (SELECT dst AS node, string_agg(src::VARCHAR, ', ' ORDER BY src) AS by_ FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges) WHERE k <= 5 GROUP BY 1),
        r AS (SELECT facts.*, by_, {_ROLE} AS role, concat_ws(' and ', CASE WHEN fan_out > 0 THEN 'imports ' || fan_out || CASE WHEN fan_out = 1 THEN ' file' ELSE ' files' END END, CASE WHEN fan_in > 0 THEN 'is imported by ' || fan_in END,
              CASE WHEN fan_in = 0 AND fan_out = 0 AND NOT is_entry THEN 'has no imports either way' END) AS links FROM facts LEFT JOIN b USING (node))
        SELECT node, concat_ws(chr(10), name || ' is ' || CASE WHEN role = 'entry' THEN 'an ' ELSE 'a ' END || role || '.', CASE WHEN links <> '' THEN 'It ' || links || '.' END,
               CASE WHEN by_ IS NOT NULL THEN 'A change shows in: ' || by_ || CASE WHEN fan_in > 5 THEN ' and ' || (fan_in - 5) || ' others' ELSE '' END || '.' END) AS text FROM r""",
    "v_overview": _G() + "," + B.FILES + f""", l AS (SELECT lang, count(*) AS n FROM files GROUP BY 1)
        SELECT concat_ws(chr(10), (SELECT sum(n)::BIGINT || ' code files (' || string_agg(n || ' ' || lang, ', ' ORDER BY n DESC, lang) || '), ' FROM l) || (SELECT count(*) FROM edges) || ' import connections.',
          (SELECT 'Good first reads: ' || string_agg(node::VARCHAR, ', ' ORDER BY node) || '.' FROM (SELECT node FROM nodes WHERE is_entry ORDER BY node LIMIT 3)),
          (SELECT 'Most imported: ' || node || ' (' || fan_in || ' dependents).' FROM facts WHERE fan_in > 0 ORDER BY fan_in DESC, node LIMIT 1),
          (SELECT CASE WHEN count(*) > 0 THEN count(*) || ' files are imported by nothing.' END FROM facts WHERE {_ORPHAN})) AS text""",
    "v_caveats": _RESOLVE + ", " + B.FILES + """, t AS (SELECT count(*) - count(path) AS lost, floor(100.0 * count(path) / count(*) + 0.5) AS sure FROM done)
        SELECT 'unresolved imports' AS caveat, lost AS n FROM t WHERE sure < 90 UNION ALL SELECT 'left out: tooLarge', count(*) FROM files WHERE length(text) > 204800 HAVING count(*) > 0""",
    "v_layers_view": _GRAPHS["g_layers"].replace("SELECT node, max(d)::INTEGER AS layer FROM walk GROUP BY 1", ", lay AS (SELECT node, max(d)::INTEGER AS layer FROM walk GROUP BY 1), rk AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY node) AS k FROM lay)")
    + """ SELECT layer, count(*) AS n, string_agg(CASE WHEN k <= 6 THEN node::VARCHAR END, ',' ORDER BY node) AS "first" FROM rk GROUP BY 1""",
    "v_tree": "WITH " + B.FILES + r""", a AS (SELECT unnest([array_to_string(string_split(path, '/')[1:k], '/') for k in range(0, len(string_split(path, '/')))]) AS node FROM files),
        r AS (SELECT node, 'folder' AS kind, count(*) AS files FROM a GROUP BY 1 UNION ALL SELECT path, 'file', 1 FROM files)
        SELECT CASE WHEN node <> '' THEN regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent, node, kind, files, CASE WHEN node = '' THEN 0 ELSE len(string_split(node, '/')) END AS depth FROM r""",
    "v_hubs_prose": _G() + "SELECT node, name || ' has ' || fan_in || ' dependents and ' || fan_out || ' imports' AS line FROM facts WHERE fan_in >= 2",
}
