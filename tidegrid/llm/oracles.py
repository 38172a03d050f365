"""SQL for the queries that SQL can express, on the same tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Lines by (doc_id, number); a line goes if an earlier one has 80 % of the words in common. Lines that do not share one of
#: their rarest words cannot be similar, so only those meet.
LINE_DEDUP = rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM t),
s AS (SELECT doc_id, k, list_distinct({_WORDS.format(_FOLDED.format('line'))}) AS words FROM l),
f AS (SELECT w, count(*) AS c FROM (SELECT unnest(words) AS w FROM s) GROUP BY w),
e AS (SELECT doc_id, k, len(words) AS n, u.w, row_number() OVER (PARTITION BY doc_id, k ORDER BY c, u.w) AS place
      FROM (SELECT *, unnest(words) AS w FROM s) u JOIN f ON f.w = u.w),
p AS (SELECT doc_id, k, n, w FROM e WHERE place <= n - (4 * n + 4) // 5 + 1),
m AS (SELECT DISTINCT a.doc_id AS ad, a.k AS ak, b.doc_id AS bd, b.k AS bk FROM p a JOIN p b
      ON a.w = b.w AND (a.doc_id, a.k) < (b.doc_id, b.k) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT bd AS doc_id, bk AS k FROM (SELECT m.*, len(x.words) + len(y.words) AS total, len(list_intersect(x.words, y.words)) AS common
      FROM m JOIN s x ON x.doc_id = ad AND x.k = ak JOIN s y ON y.doc_id = bd AND y.k = bk) WHERE 5 * common >= 4 * (total - common))
SELECT doc_id, any_value(n_lines) AS n_lines, count(gone) AS n_removed,
 CASE WHEN any_value(n_lines) > 0 THEN coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE gone IS NULL), '') END AS text
FROM (SELECT l.doc_id, l.k, l.line, t.n_lines, g.k AS gone FROM l JOIN (SELECT doc_id, len(lines) AS n_lines FROM t) t USING (doc_id) LEFT JOIN g ON g.doc_id = l.doc_id AND g.k = l.k)
GROUP BY doc_id"""

#: Bytes as pairs of hexadecimal digits. Every 200-byte string that starts at two places takes its bytes along.
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS bytes FROM t),
w AS (SELECT doc_id, k, hash(substr(h, 2 * k + 1, 400)) AS name FROM (SELECT doc_id, h, unnest(range(0, bytes - 199)) AS k FROM n)),
r AS (SELECT doc_id, k FROM w WHERE name IN (SELECT name FROM w GROUP BY name HAVING count(*) > 1)),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run
      FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, run, min(k) AS low, max(k) + 200 AS high FROM i GROUP BY ALL),
c AS (SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS before FROM s),
k AS (SELECT c.doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS parts FROM c JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT n.doc_id, bytes AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE parts || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id"""

HYPERMINHASH = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_FOLDED.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, coalesce(low, doc_id) >= doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a) USING (doc_id)"""

_RATES = {"short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "n_dup_lines >= 10"}
_FAILURES = ", ".join(f"count(*) FILTER (WHERE {rule}) AS f_{name}" for name, rule in _RATES.items())
_MEANS = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}" for r in _RATES)
_SPREADS = ", ".join(f"sum(n * (f_{r} / n - m_{r}) ** 2) / sum(n) AS v_{r}" for r in _RATES)
_WEIGHT = "CASE WHEN v_{0} > 1e-12 THEN greatest(1.0, m_{0} * (1 - m_{0}) / v_{0} - 1) ELSE 1000000.0 END"
_FAILED = " OR ".join(f"(f_{r} + {_WEIGHT.format(r)} * m_{r}) / (n + {_WEIGHT.format(r)}) > 0.6" for r in _RATES)

HOST_RULES = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {_WORDS.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM d) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
h AS (SELECT source, count(*) AS n, {_FAILURES} FROM c WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT {_MEANS} FROM h),
v AS (SELECT {_SPREADS} FROM h, m),
j AS (SELECT source, ({_FAILED}) AS host_failed FROM h, m, v),
b AS (SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(host_failed, false) AS host_failed FROM c LEFT JOIN j ON j.source = c.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept FROM b"""

_HASH60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_DRAW = _HASH60.format("concat_ws(':', 17, name, shard, bundle, {0})")


def _dealt(claims: str, within: str, item: str) -> str:
    """Every quotient of every claim laid out; the highest ``seats`` of a group, as many as its seats, each item up to its cap."""
    keys = f"{within}, {item}" if within else item
    part = f"PARTITION BY {within}" if within else ""
    return f"""SELECT {keys}, any_value(blocks) AS blocks, count(*) FILTER (WHERE place <= seats) AS quota FROM (
      SELECT *, row_number() OVER ({part} ORDER BY claim / (2 * k + 1) DESC, {item}) AS place
      FROM (SELECT *, unnest(range(0, cap)) AS k FROM {claims})) GROUP BY {keys}"""


def _before(x: str) -> str:
    """Words taken before word ``x`` of a bundle: whole rounds, and one block drawn from each of ``rest`` equal stretches of blocks."""
    block = f"(({x}) // 16)"
    stretch = f"((({block} + 1) * rest - 1) // blocks)"
    low, high = f"({stretch} * blocks // rest)", f"(({stretch} + 1) * blocks // rest)"
    pick = f"({low} + {_DRAW.format(stretch)} % ({high} - {low}))"
    return f"""(every * ({x}) + CASE WHEN rest = 0 THEN 0 WHEN {block} >= blocks THEN 16 * rest
      ELSE 16 * ({stretch} + CASE WHEN {pick} < {block} THEN 1 ELSE 0 END) + CASE WHEN {pick} = {block} THEN ({x}) - 16 * {block} ELSE 0 END END)"""


SAINTE_LAGUE = rf"""
WITH t AS (SELECT source, coalesce('s' || source, '') AS name, doc_id, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
  {_HASH60.format("concat_ws(':', 17, coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))")} AS uid FROM documents),
s AS (SELECT name, sum(size)::BIGINT AS words, (count(*) + 1023) // 1024 AS bundles,
  [5, 2, 1][1 + (row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3] AS weight FROM t GROUP BY name),
v AS (SELECT *, 2 * words AS cap, 2 * words / weight AS room, ceil(sqrt(bundles))::BIGINT AS shards FROM s),
l AS (SELECT *, (1.5 * sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY room, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY room, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
g AS (SELECT *, least(cap::DOUBLE, (SELECT min_by(level, room) FROM l WHERE level <= room) * weight) AS target FROM l),
r AS (SELECT t.*, g.words AS source_size, target, uid % shards AS shard, (uid // shards) % ((bundles + shards - 1) // shards) AS bundle FROM t JOIN g USING (name)),
b AS (SELECT name, shard, bundle, (sum(size)::BIGINT + 15) // 16 AS blocks FROM r GROUP BY ALL HAVING sum(size) > 0),
h AS (SELECT name, shard, sum(blocks)::BIGINT AS blocks FROM b GROUP BY ALL),
c1 AS (SELECT name, blocks, target * blocks / words AS claim, 2 * blocks AS cap FROM (SELECT name, sum(blocks)::BIGINT AS blocks FROM b GROUP BY name) JOIN g USING (name)),
q1 AS ({_dealt("(SELECT *, (SELECT round(sum(claim::DECIMAL(30,6)))::BIGINT FROM c1) AS seats FROM c1)", "", "name")}),
q2 AS ({_dealt("(SELECT h.name, shard, quota * h.blocks / q1.blocks AS claim, 2 * h.blocks AS cap, quota AS seats, h.blocks FROM h JOIN q1 USING (name))", "name", "shard")}),
q3 AS ({_dealt("(SELECT b.name, b.shard, bundle, quota * b.blocks / q2.blocks AS claim, 2 * b.blocks AS cap, quota AS seats, b.blocks FROM b JOIN q2 USING (name, shard))", "name, shard", "bundle")}),
p AS (SELECT r.*, coalesce(blocks, 0) AS blocks, coalesce(quota // blocks, 0) AS every, coalesce(quota % blocks, 0) AS rest,
  sum(size) OVER (PARTITION BY name, shard, bundle ORDER BY doc_id NULLS FIRST, uid ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM r LEFT JOIN q3 USING (name, shard, bundle))
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN {_before("stop")} - {_before("stop - size")} ELSE 0 END)::BIGINT AS taken FROM p"""

_ORDERS = "SELECT a || b || c || d || e AS filter_order, [a, b, c, d, e] AS f FROM x x1(a), x x2(b), x x3(c), x x4(d), x x5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5"

RETRACTION_AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
m AS (SELECT doc_id, part, list_filter([CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > low THEN 'E' END], lambda i: i IS NOT NULL) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS ({_ORDERS}),
s AS (SELECT filter_order, f[k] AS name, f[1:k - 1] AS before, k AS step FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, name, n, good, toxic, list_contains(fails, name) AS hit, len(list_intersect(fails, before)) > 0 AS gone, fails = [name] AS lone FROM c, s),
q AS (SELECT part, filter_order, step, name,
  (coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0))::BIGINT AS removed,
  (coalesce(sum(n) FILTER (WHERE hit AND gone), 0))::BIGINT AS redundant, (coalesce(sum(n) FILTER (WHERE lone), 0))::BIGINT AS unique_fails,
  (coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0))::BIGINT AS good_lost, (coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0))::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM q"""

_TERMS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

DUAL_TREE = f"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format('text')} AS terms FROM benchmark),
q AS (SELECT item, term, count(*) AS c FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format('text')} AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS documents, sum(len(terms))::BIGINT AS words FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT row, doc_id, p.term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // words))) AS value
  FROM p JOIN f USING (term), s),
r AS (SELECT item, row, doc_id, sum(c * value)::BIGINT AS score FROM v JOIN q USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM r WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM o JOIN i USING (item) WHERE place <= 10"""
