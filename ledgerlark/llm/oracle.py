"""SQL for the Merkle manifest and for importance resampling: plain forms, without blocks or
dictionaries. The checksum is computed bit by bit, as SQL has no function for it."""

from __future__ import annotations

#: The checksum's table of 256 values, from its polynomial.
_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda v, x: xor(v >> 8, t[1 + (xor(v, x) & 255)])), 4294967295)"


def importance(buckets: int, seed: int, least_words: int, percent: int) -> str:
    def words(text: str) -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return rf"""WITH {_TABLE},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS words FROM documents),
held AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM docs) GROUP BY ALL),
aims AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({words('text')}) AS w FROM benchmark) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, {_crc32('w')} % {buckets} AS bucket FROM (SELECT w FROM held UNION SELECT w FROM aims), crc),
s AS (SELECT bucket, sum(n) AS n FROM held JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM aims JOIN hashed USING (w) GROUP BY 1),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE))) AS g FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, sum(n * g) AS weight FROM held JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS MATERIALIZED (SELECT r, doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT)
  + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= {least_words})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {percent} * fit // 100 THEN CAST(place AS BIGINT) END AS rank FROM scored LEFT JOIN placed USING (r)"""


def merkle(levels: int = 16) -> str:
    """Every level of all trees as a table, up to 3 ** levels leaves a tree; a tree that has come to one
    node stays as it is. p: the node's place, l and r: the run's others before and after it."""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR) END" for f in fields) + ")"

    def level(name: str, before: str) -> str:
        """One level up, and with it the runs of the level below."""
        return f"""{name} AS MATERIALIZED (SELECT g, k // 3 AS k, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY k)) ELSE min(h) END AS h, (max(n) + 2) // 3 AS n FROM {before} GROUP BY g, k // 3),
{before}_runs AS MATERIALIZED (SELECT g, k, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {before} WINDOW w AS (PARTITION BY g, k // 3 ORDER BY k))"""

    hit = f"{_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0"
    parts = [
        _TABLE,
        f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY coalesce('+' || source, '')) - 1 AS g
  FROM (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {hit} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claim FROM documents, crc))""",
        "a0 AS MATERIALIZED (SELECT g, k, leaf AS h, n FROM leaves)",
        *(level(f"a{i + 1}", f"a{i}") for i in range(levels)),
        f"b0 AS MATERIALIZED (SELECT 0 AS g, g AS k, h, count(*) OVER () AS n FROM a{levels})",
        *(level(f"b{i + 1}", f"b{i}") for i in range(levels)),
        f"p0 AS (SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, l.g, l.k, '' AS proof, l.claim AS node FROM leaves l JOIN b0 s ON s.k = l.g JOIN b{levels} t ON true)",
    ]
    at = "p0"
    for tree, key, place in (("a", "x.g", "x.k"), ("b", "0", "x.g")):
        for i in range(levels):
            step = f"p_{tree}{i}"
            parts.append(f"""{step} AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.subroot, x.root, x.g, x.k, x.proof || CASE WHEN y.n > 1 THEN y.l || y.r ELSE '' END AS proof,
  CASE WHEN y.n > 1 THEN sha256(y.l || x.node || y.r) ELSE x.node END AS node FROM {at} x JOIN {tree}{i}_runs y ON y.g = {key} AND y.k = {place} // {3**i})""")
            at = step
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM {at}"
