"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

import hashlib

from trawl.llm.licenses import TEMPLATES

#: Text of ``documents`` with A-Z in lower case, cut into words.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn >') + length('</turn>') + 1 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def licence_scan() -> str:
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in TEMPLATES.items())
    return rf"""
WITH templates(license_id, text) AS (VALUES {values}),
t_words AS (
  SELECT license_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates
), t_grams AS (
  SELECT license_id, len(w) - 1 AS t_size, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM t_words
), t_counts AS (SELECT license_id, t_size, bigram, count(*) AS n FROM t_grams GROUP BY ALL),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents
), units AS (
  SELECT r, 'd' AS kind, 0 AS place, norm AS u FROM docs
  UNION ALL SELECT r, 'p', generate_subscripts(x, 1), unnest(x) FROM (SELECT r, regexp_split_to_array(norm, '\n *\n[ \n]*') AS x FROM docs)
  UNION ALL SELECT r, 'l', generate_subscripts(x, 1), unnest(x) FROM (SELECT r, string_split(norm, chr(10)) AS x FROM docs)
), u_words AS (
  SELECT r, kind, place, string_split(trim(regexp_replace(u, '[ \n]+', ' ', 'g')), ' ') AS w FROM units
), u_grams AS (
  SELECT r, kind, place, len(w) - 1 AS size, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM u_words WHERE len(w) BETWEEN 2 AND 1000
), u_counts AS (SELECT r, kind, place, size, bigram, count(*) AS n FROM u_grams GROUP BY ALL),
common AS (
  SELECT r, kind, place, size, license_id, t_size, sum(least(u.n, t.n)) AS shared FROM u_counts u JOIN t_counts t USING (bigram) GROUP BY ALL
), hits AS (
  SELECT r, license_id, round(2 * shared::DOUBLE / (size + t_size), 6) AS dice FROM common WHERE 200 * shared >= 80 * (size + t_size)
), best AS (
  SELECT r, arg_min(license_id, (-dice, license_id)) AS license_id, max(dice) AS dice, count(*) AS n_matches,
    array_to_string(list_sort(list(DISTINCT license_id)), ',') AS license_ids
  FROM hits GROUP BY r
)
SELECT doc_id, license_id, dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(license_ids, '') AS license_ids
FROM docs LEFT JOIN best USING (r)
"""


DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, unnest([w[i + 1:i + 13] for i in range(0, greatest(len(w) - 13, 0) + 1)]) AS x FROM items WHERE len(w) > 0 AND item_id IS NOT NULL
), lengths AS (SELECT DISTINCT len(x) AS n FROM windows),
stretches AS (
  SELECT r, n, unnest(range(0, len(w) - n + 1)) AS i, unnest([w[j + 1:j + n] for j in range(0, len(w) - n + 1)]) AS x
  FROM docs, lengths WHERE len(w) >= n
), hits AS (SELECT r, i, n, item_id FROM stretches JOIN windows USING (x)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


def sharding(shards: int = 40, seed: int = 0) -> str:
    """Checksums by nibbles, the permutation round by round; a second pass walks on where the first left [0, n)."""
    def crc_nibble(v: int) -> int:
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        return v

    crc_table = [crc_nibble(i) for i in range(16)]
    prime = (1 << 31) - 1
    steps, last = [], "s0"
    for walk in range(13):
        more = "TRUE" if walk == 0 else "x >= n"
        steps.append(f"w{walk}_0 AS (SELECT *, x // b AS l, x % b AS r FROM {last})")
        at = f"w{walk}_0"
        for i in range(6):
            key = hashlib.sha256(f"{seed}/{i}".encode()).hexdigest()  # its first two groups of 32 bits, without the last two bits
            k1, k2 = int(key[:8], 16) // 4, int(key[8:16], 16) // 4
            a, m, o = ("l", "a", "r") if i % 2 == 0 else ("r", "b", "l")
            mix = f"(({o} % {prime} + {k1}) % {prime}) * (({o} % {prime} + {k2}) % {prime}) % {prime}"
            steps.append(f"w{walk}_{i + 1} AS (SELECT * REPLACE (({a} + {mix}) % {m} AS {a}) FROM {at})")
            at = f"w{walk}_{i + 1}"
        steps.append(f"s{walk + 1} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN {more} THEN l * b + r ELSE x END AS x) FROM {at})")
        last = f"s{walk + 1}"
    return f"""
WITH bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [strpos('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 for i in range(1, length(h) + 1)]),
    lambda c, v: xor(c >> 4, ({crc_table})[xor(c & 15, v) + 1]))) AS text_crc32
  FROM bytes
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sums
), s00 AS (
  SELECT *, greatest(1, floor(sqrt(n - 1))::BIGINT + 1) AS a FROM numbered
), s0 AS (
  SELECT *, greatest(1, (n + a - 1) // a) AS b FROM s00
), {", ".join(steps)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM {last}
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w
  FROM documents
), docs AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
items AS (
  SELECT row_number() OVER () AS q, item_id,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS w
  FROM benchmark
), asked AS (SELECT q, item_id, unnest(w) AS t FROM items),
postings AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, stats GROUP BY t, big_n
), scored AS (
  SELECT q, item_id, r, doc_id, sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN docs USING (r), stats GROUP BY q, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def prefix_trie() -> str:
    """Prefixes as running concatenations of turn digests; every subtree is summed by taking each node's share to all of
    its ancestors, which are the prefixes of its least member."""
    def nibble(v: int) -> int:
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        return v

    nibbles = [nibble(i) for i in range(16)]
    crc = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [strpos('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 for i in range(1, length(x) + 1)]),
    lambda a, v: xor(a >> 4, ({nibbles})[xor(a & 15, v) + 1])))"""
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (SELECT conv_id, m, length(text)::BIGINT AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i FROM said),
convs AS (SELECT c, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id AS c, hex(encode(conv_id::VARCHAR)) AS x FROM turns)),
rebuilt AS (
  SELECT c, m, len, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM (
    SELECT c, m, len, i FROM convs JOIN turns ON conv_id = c - c % 100 AND i <= h
    UNION ALL SELECT c, m, len, i FROM convs JOIN turns ON conv_id = c AND i > h)
), steps AS (
  SELECT c, 0 AS d, '' AS k, NULL AS up, 0 AS len FROM convs
  UNION ALL SELECT c, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), ''), len
  FROM (SELECT c, d, len, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM rebuilt)
), nodes AS (SELECT k, min(c) AS c, any_value(d) AS d, any_value(up) AS up, count(*) AS n, any_value(len) AS len FROM steps GROUP BY k),
below AS (SELECT up AS k, count(*) AS children FROM nodes WHERE up IS NOT NULL GROUP BY up),
shares AS (
  SELECT s.k, sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.len) AS saved
  FROM nodes n LEFT JOIN below b ON b.k = n.k JOIN steps s ON s.c = n.c AND s.d <= n.d GROUP BY s.k
), ends AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM steps WHERE (c, d) IN (SELECT (c, max(d)) FROM steps GROUP BY c) GROUP BY k
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.k = n.up LEFT JOIN below b ON b.k = n.k JOIN shares s ON s.k = n.k LEFT JOIN ends e ON e.k = n.k
"""


TOP_K = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM good q JOIN good c ON c.r <> q.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""


STATEMENTS = {
    "op3_chat_format": CHAT,
    "op5_license_scan": licence_scan(),
    "op6_decontamination": DECONTAMINATION,
    "op8_sharding": sharding(),
    "op11_lexical_search": LEXICAL,
    "op12_conversation_trie": prefix_trie(),
    "op13_topk_search": TOP_K,
}
