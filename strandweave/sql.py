"""SQL of the graph, scaffold and file queries, for comparison on the same tables. Written from the definitions, not from the operators."""

from __future__ import annotations

DOUBLINGS = 18  # chains of up to 2**18 edges


def chains(graph: str, out: str) -> str:
    """CTEs from ``graph`` (src, dst, base, weight) to ``out`` (head, rank, src, dst, base, weight): chains of nodes that are one-in-one-out, by doubling."""
    steps = [
        f"{out}_deg AS (SELECT node, sum(i) AS indeg, sum(o) AS outdeg FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {graph} UNION ALL SELECT dst, 1, 0 FROM {graph}) GROUP BY node)",
        f"{out}_e AS MATERIALIZED (SELECT row_number() OVER () AS id, g.*, d.indeg = 1 AND d.outdeg = 1 AS inner_src FROM {graph} g JOIN {out}_deg d ON d.node = g.src)",
        f"{out}_0 AS MATERIALIZED (SELECT e.id, CASE WHEN e.inner_src THEN p.id ELSE e.id END AS up, CASE WHEN e.inner_src THEN 1 ELSE 0 END AS rank FROM {out}_e e LEFT JOIN {out}_e p ON e.inner_src AND p.dst = e.src)",
    ]
    for i in range(DOUBLINGS):
        steps.append(f"{out}_{i + 1} AS MATERIALIZED (SELECT a.id, b.up, a.rank + b.rank AS rank FROM {out}_{i} a JOIN {out}_{i} b ON a.up = b.id)")
    steps.append(f"{out} AS MATERIALIZED (SELECT h.src || h.base AS head, s.rank, e.src, e.dst, e.base, e.weight FROM {out}_{DOUBLINGS} s JOIN {out}_e e ON e.id = s.id JOIN {out}_e h ON h.id = s.up WHERE NOT h.inner_src)")
    return ", ".join(steps)


UNITS = (
    "units AS (SELECT head, min_by(src, rank) AS src_node, max_by(dst, rank) AS dst_node, min_by(src, rank) || string_agg(base, '' ORDER BY rank) AS seq, "
    "sum(weight) / count(*) AS coverage, count(*)::BIGINT AS n_edges FROM chain GROUP BY head)"
)


def unitigs(edges: str) -> str:
    return f"WITH {edges}, main AS (SELECT * FROM edges WHERE weight > 1), {chains('main', 'chain')}, {UNITS} SELECT seq, round(coverage, 6) AS coverage, n_edges FROM units"


def condensed(edges: str) -> str:
    return (
        f"WITH {edges}, main AS (SELECT * FROM edges WHERE weight > 1), {chains('main', 'chain')}, {UNITS}, "
        "ids AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT src_node AS node FROM units UNION SELECT dst_node FROM units)) "
        "SELECT row_number() OVER (ORDER BY seq, head)::BIGINT AS edge_id, a.id::BIGINT AS src_id, b.id::BIGINT AS dst_id, seq, round(coverage, 6) AS coverage FROM units JOIN ids a ON a.node = src_node JOIN ids b ON b.node = dst_node"
    )


def trimmed(edges: str, loops: int = 2) -> str:
    parts, graph = [], "main"
    for i in range(loops):
        parts.append(chains(graph, f"c{i}"))
        parts.append(
            f"t{i} AS (SELECT head, min_by(src, rank) AS f, max_by(dst, rank) AS b, count(*) AS n, avg(weight) AS c, max(length(src)) AS l FROM c{i} GROUP BY head), "
            f"bad{i} AS (SELECT head FROM t{i} JOIN c{i}_deg x ON x.node = f JOIN c{i}_deg y ON y.node = b, average WHERE "
            "CASE WHEN (x.indeg = 0 AND x.outdeg = 1) OR (y.indeg = 1 AND y.outdeg = 0) THEN n + 1 < l + 2 OR c < a / 5 ELSE (n + 1 < l + 2 AND c < a / 5) OR c <= 3 OR c < a / 10 END), "
            f"g{i} AS MATERIALIZED (SELECT src, dst, base, weight FROM c{i} WHERE head NOT IN (SELECT head FROM bad{i}))"
        )
        graph = f"g{i}"
    return f"WITH {edges}, average AS (SELECT coalesce(avg(cnt) FILTER (WHERE cnt >= 4), 1.0) AS a FROM counts), main AS (SELECT * FROM edges WHERE weight > 1), {', '.join(parts)} SELECT src, dst, base, weight FROM {graph}"


def rescued(edges: str, degrees: str) -> str:
    """One candidate after the other in order of the k-mer; one that finds its ends free takes them."""
    return (
        f"WITH RECURSIVE {edges}, main AS (SELECT * FROM edges WHERE weight <> 1), {degrees}, "
        "cand AS MATERIALIZED (SELECT e.*, row_number() OVER (ORDER BY e.src, e.base) AS i FROM edges e JOIN deg a ON a.node = e.src AND a.outdeg = 0 JOIN deg b ON b.node = e.dst AND b.indeg = 0 WHERE weight = 1), "
        # only candidates that share an end with an earlier one can be refused, and only these need to be gone through in order
        "tied AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY i) AS t FROM (SELECT *, count(*) OVER (PARTITION BY src) AS x, count(*) OVER (PARTITION BY dst) AS y FROM cand) WHERE x > 1 OR y > 1), "
        "walk(t, used_src, used_dst, ok) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false UNION ALL "
        "SELECT c.t, CASE WHEN f THEN list_append(used_src, c.src) ELSE used_src END, CASE WHEN f THEN list_append(used_dst, c.dst) ELSE used_dst END, f "
        "FROM (SELECT c.*, w.used_src, w.used_dst, NOT list_contains(w.used_src, c.src) AND NOT list_contains(w.used_dst, c.dst) AS f FROM walk w JOIN tied c ON c.t = w.t + 1) c), "
        "refused AS (SELECT i FROM tied JOIN walk USING (t) WHERE NOT ok) "
        "SELECT * FROM main UNION ALL SELECT src, dst, base, weight FROM cand WHERE i NOT IN (SELECT i FROM refused)"
    )


def scaffolds(members: str, gaps: str, k: int, insert: int, delta: float) -> str:
    """Sequences of scaffolds of one or two contigs: an overlap is cut, else the path of nearest length fills the gap, else N."""
    allowed, most = (k - 1) + 3 * delta + 30, int(insert + 3 * delta)
    return (
        f"WITH RECURSIVE {members}, gaps AS MATERIALIZED ({gaps}), joints AS MATERIALIZED (SELECT contig_id, left(seq, {k - 1}) AS b, right(seq, {k - 1}) AS e, length(seq) - {k - 1} AS more, left(seq, length(seq) - {k - 1}) AS body FROM contigs WHERE length(seq) >= {k}), "
        f"paths(scaffold_id, goal, gap, here, n, len, path, fill, inner_len) AS (SELECT scaffold_id, \"right\", gap, \"left\", 1, {1 - k}::BIGINT, [\"left\"], '', NULL::BIGINT FROM gaps WHERE kind = 'search' UNION ALL "
        "SELECT p.scaffold_id, goal, gap, y.contig_id, n + 1, len + y.more, list_append(path, y.contig_id), CASE WHEN n > 1 THEN fill || x.body ELSE fill END, len "
        f"FROM paths p JOIN joints x ON x.contig_id = p.here JOIN joints y ON y.b = x.e WHERE len <= gap + {allowed} - {k - 1} AND n <= {most}), "
        "best AS (SELECT scaffold_id, fill FROM paths WHERE n > 1 AND here = goal QUALIFY row_number() OVER (PARTITION BY scaffold_id ORDER BY abs(inner_len - gap), n, path, inner_len) = 1), "
        "sides AS (SELECT m.component_id AS scaffold_id, max(seq) FILTER (WHERE ord = (m.least)) AS a, max(seq) FILTER (WHERE ord <> m.least) AS b FROM (SELECT *, min(ord) OVER (PARTITION BY component_id) AS least FROM members) m JOIN contigs USING (contig_id) GROUP BY 1), "
        f"done AS (SELECT s.scaffold_id, CASE WHEN b IS NULL THEN a WHEN fill IS NOT NULL THEN left(a, length(a) - {k - 1}) || fill || b WHEN g.gap <= 0 THEN CASE WHEN length(a) >= -g.gap THEN left(a, length(a) + g.gap) ELSE a END || b "
        f"ELSE a || repeat('N', least({most}, g.gap)) || b END AS seq FROM sides s LEFT JOIN gaps g USING (scaffold_id) LEFT JOIN best USING (scaffold_id)) "
        "SELECT scaffold_id, 0::BIGINT AS part, length(seq)::BIGINT AS len, seq FROM done"
    )


def kept_scaffolds(shares: str) -> str:
    """Longest first; one that was not flagged before it is reached stays and flags those that share two contigs or more with it."""
    return (
        f"WITH RECURSIVE {shares}, lengths AS (SELECT floor(contig_id / 10000)::BIGINT AS id, sum(length(seq))::BIGINT AS length FROM both_ways GROUP BY 1), "
        "near AS MATERIALIZED (SELECT a, list(b) AS bs FROM shared WHERE n >= 2 GROUP BY a), "
        "turn AS MATERIALIZED (SELECT id, length, bs, row_number() OVER (ORDER BY length DESC, id) AS t FROM lengths JOIN near ON a = id), "
        "walk(t, flagged, ok) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT c.t, CASE WHEN list_contains(w.flagged, c.id) THEN w.flagged ELSE list_distinct(list_concat(w.flagged, c.bs)) END, NOT list_contains(w.flagged, c.id) FROM walk w JOIN turn c ON c.t = w.t + 1) "
        "SELECT id AS component_id, length FROM lengths WHERE id NOT IN (SELECT id FROM turn JOIN walk USING (t) WHERE NOT ok)"
    )
