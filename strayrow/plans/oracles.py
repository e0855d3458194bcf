"""The same results in plain SQL, for the queries SQL can express."""

from __future__ import annotations

from strayrow.functions.expressions import ALERT_TEXT
from strayrow.functions.hashing import ORDER_TAG, UNIFORM_STEPS, UNIFORM_TAG
from strayrow.functions.poisson import poisson_thresholds
from strayrow.plans.catalogue import (
    EVENT_FEATURES,
    FRACTION,
    LANDED_BYTES,
    LANDED_FILES,
    PAIR_DIGITS,
    PAIR_FEATURES,
    PAIR_SITES,
    SEED,
    VECTOR_WIDTH,
)

EVENT_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
FLAGGED = """
SELECT event_id, ts, value, strftime(ts, '%Y-%m-%d %H') AS batch,
       CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS prediction
FROM events"""


def row_text(columns: list[str]) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in columns]
    return f"concat({', '.join(parts)})"


def text_hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


# The constants of the public xxHash64 algorithm, and the seed Spark starts it from.
XX_PRIMES = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
XX_SEED = 42


def mixed(source: str, numbers: list[str], out: str) -> str:
    """``source`` with column ``out``: the numbers hashed one after the other by xxHash64."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in XX_PRIMES)
    word = f"{1 << 64}::UHUGEINT"

    def times(a: str, b: str) -> str:
        return f"(({a}) * {b}) % {word}"

    def turned(a: str, bits: int) -> str:
        return f"(({a} * {1 << bits}::UHUGEINT) % {word} + {a} // {1 << (64 - bits)}::UHUGEINT)"

    def folded(a: str, bits: int) -> str:
        return f"xor({a}, {a} // {1 << bits}::UHUGEINT)"

    seed = f"{XX_SEED}::UHUGEINT"
    for number in numbers:
        source = f"""
SELECT * EXCLUDE (_a, _b, _c, _d, _e, _f, _g, _h), {folded('_h', 32)} AS {out} FROM (
  SELECT *{f' EXCLUDE ({out})' if seed == out else ''},
    {times(f'({number})::UHUGEINT', p2)} AS _a,
    {times(turned('_a', 31), p1)} AS _b,
    xor(({seed} + {p5} + 8::UHUGEINT) % {word}, _b) AS _c,
    ({times(turned('_c', 27), p1)} + {p4}) % {word} AS _d,
    {folded('_d', 33)} AS _e, {times('_e', p2)} AS _f,
    {folded('_f', 29)} AS _g, {times('_g', p3)} AS _h
  FROM ({source}))"""
        seed = out
    return source


def with_row_hash(source: str, key: str | None) -> str:
    """``source`` with the hash of its whole-number ``key``, or else of its text ``row_id``."""
    if key is None:
        return f"SELECT *, {text_hash('row_id')} AS row_hash FROM ({source})"
    return f"SELECT *, key_mix // 16 AS row_hash FROM ({mixed(source, [key], 'key_mix')})"


def with_uniform(source: str, key: str | None, seed: int = SEED) -> str:
    """``source`` (feature, ...) with the hash of the row and the uniform of the feature."""
    numbers = ["row_hash", f"{seed}", "feature", f"{UNIFORM_TAG}"]
    hashed = mixed(with_row_hash(source, key), numbers, "uniform")
    return f"SELECT *, uniform // 4096 AS u FROM ({hashed})"


def with_order(source: str, seed: int = SEED) -> str:
    numbers = ["row_hash", f"{seed}", "feature", "draw", f"{ORDER_TAG}"]
    return f"SELECT *, mixture // 16 AS place_hash FROM ({mixed(source, numbers, 'mixture')})"


def covering_draws(source: str, wanted: str, key: str | None, seed: int = SEED) -> str:
    """CTEs from ``source`` (feature, payload...) to its draws."""
    return f"""
source AS ({with_uniform(source, key, seed)}),
size AS (SELECT count(*) AS n, {wanted} AS m FROM source WHERE feature = 0),
rate AS (SELECT m, (m + 7.5 * sqrt(m) + 40.0) / n AS rate FROM size),
cdf AS (
  SELECT k, floor(sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (ORDER BY k)
                  * {UNIFORM_STEPS}) AS step
  FROM rate, range(0, 80) AS counts(k)),
drawn AS (
  SELECT s.*, k AS draw
  FROM source s JOIN cdf ON CAST(u AS BIGINT) >= step AND step < {UNIFORM_STEPS} - 1),
ordered AS ({with_order('SELECT * FROM drawn', seed)})"""


def long_form(columns: dict[str, str], key: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {j} AS feature, CAST({expression} AS DOUBLE) AS value FROM {source}"
        for j, expression in enumerate(columns.values())
    )


def resampled(
    long: str, key: str, names: list[str], mode: str, fraction: float, seed: int = SEED
) -> str:
    """CTEs up to ``synthetic``: the marginal resample of a long-form source."""
    if mode == "exact":
        ctes = covering_draws(long, f"floor({fraction} * count(*) + 1e-9)", key, seed)
        condition = "AND position < (SELECT m FROM rate)"
    else:
        drawn = f"SELECT *, unnest(range({repeats('u')})) AS draw FROM ({with_uniform(long, key)})"
        ctes = f"ordered AS ({with_order(drawn)})"
        condition = ""
    wide = ", ".join(
        f"max(CASE WHEN feature = {j} THEN value END) AS {c}" for j, c in enumerate(names)
    )
    return f"""{ctes},
pieces AS (
  SELECT feature, value,
         row_number() OVER (PARTITION BY feature ORDER BY place_hash, value) - 1 AS position
  FROM ordered),
synthetic AS (
  SELECT position AS row_no, {wide}
  FROM pieces GROUP BY position HAVING count(*) = {len(names)} {condition})"""


def identified(columns: list[str], source: str) -> str:
    """Rows of ``source`` with the text that identifies each, copies numbered."""
    return f"""
  SELECT *, concat_ws('#', {row_text(columns)}, CAST(copy_no AS VARCHAR)) AS row_id
  FROM (SELECT {', '.join(columns)},
               row_number() OVER (PARTITION BY {', '.join(columns)}) - 1 AS copy_no
        FROM {source})"""


def repeats(uniform: str) -> str:
    return " + ".join(f"CAST({uniform} >= {t} AS INT)" for t in poisson_thresholds(FRACTION))


def labels_by_frequency(column: str) -> str:
    return f"""
SELECT {column}, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS n
FROM events GROUP BY {column}"""


LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

EVENT_COLUMNS = {c: EVENT_K if c == "k" else c for c in EVENT_FEATURES}
STAMPED = ["event_id", "user_id", "event_type"]
ORDERED = ["o_orderkey", "o_custkey", "o_orderpriority"]
VECTOR = [f"v{j}" for j in range(VECTOR_WIDTH)]

_event_long = long_form(EVENT_COLUMNS, "event_id", "events")
_event_resample = resampled(_event_long, "event_id", EVENT_FEATURES, "exact", FRACTION)
_vector_long = """
SELECT vec_id, unnest(range(len(embedding))) AS feature,
       CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings"""
_events_by_id = f"SELECT event_id, value, {EVENT_K} AS k, user_id, 0 AS feature FROM events"
_event_uuid = f"md5(concat_ws('|', CAST(sequence_id AS VARCHAR), {row_text(STAMPED)}))"

# What a forest learns of pairs that always fit together: 0 for those that don't.
PAIRS = {"digit": f"user_id % {PAIR_DIGITS}", "triple": f"(user_id % {PAIR_DIGITS}) * 3 + 1"}
_pair_resample = resampled(
    long_form(PAIRS, "event_id", "events"), "event_id", PAIR_FEATURES, "exact", 1.0, SEED + 1
)
PAIR_MESSAGES = f"""{_pair_resample},
messages AS (
  SELECT 'real' AS source, 'real:' || {row_text(['event_id'])} AS line_id,
         CAST({PAIRS['digit']} AS DOUBLE) AS digit, CAST({PAIRS['triple']} AS DOUBLE) AS triple
  FROM events
  UNION ALL SELECT 'synthetic', 'synthetic:' || CAST(row_no AS VARCHAR), digit, triple FROM synthetic),
scored AS (
  SELECT *, CASE WHEN triple = 3 * digit + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vote,
         CAST(digit AS BIGINT) % {PAIR_SITES} AS slice
  FROM messages)"""

ORACLES = {
    "csv_declared_scan": """
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_partkey AS DOUBLE) AS l_partkey,
       CAST(l_suppkey AS DOUBLE) AS l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
FROM lineitem""",
    "csv_quarantine": f"""
SELECT CASE l_returnflag
         WHEN 'A' THEN concat_ws(',', l_orderkey, l_partkey)
         WHEN 'N' THEN line || ',extra'
         ELSE 'x' || line END AS raw,
       'malformed csv' AS reason
FROM (SELECT *, concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in LINEITEM)}) AS line
      FROM lineitem)""",
    "json_scan": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "multi_site_scan": """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'site' || CAST(user_id % 2 AS VARCHAR) AS site,
       count(*) AS rows, CAST(sum(user_id) AS BIGINT) AS user_ids, max(event_id) AS last_event
FROM events GROUP BY 1, 2""",
    "json_parse": f"SELECT event_id, {EVENT_K} AS k FROM events",
    "json_roundtrip": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders""",
    "quarantine": f"""
SELECT CASE WHEN event_type = 'error' THEN 'malformed json' ELSE 'kept' END AS status,
       count(*) AS rows,
       CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE {EVENT_K} END) AS BIGINT) AS k_sum
FROM events GROUP BY 1""",
    "kafka_encode": """
SELECT event_id, replace(CAST(ts AS VARCHAR), ' ', 'T') AS utc, user_id, event_type, value
FROM events""",
    "enrich_sum": """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, l_extendedprice,
       nullif(l_discount, 0) + l_extendedprice AS total
FROM lineitem""",
    "vector_columns": "SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id FROM events",
    "vectors_only": "SELECT value, CAST(user_id AS DOUBLE) AS user_id FROM events",
    "explode_vector": """
SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS feature,
       CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings""",
    "label_index": f"""
SELECT event_id, event_type, n AS label_index
FROM events JOIN ({labels_by_frequency('event_type')}) USING (event_type)""",
    "labeled_points": f"""
SELECT n AS event_type, value, CAST(user_id AS DOUBLE) AS user_id
FROM events e JOIN ({labels_by_frequency('event_type')}) l ON e.event_type = l.event_type""",
    "unpivot_features": _event_long,
    "rebuild_rows": f"""
SELECT event_id, value, CAST({EVENT_K} AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS user_id
FROM events""",
    "stamp_records": f"""
WITH numbered AS (
  SELECT *, row_number() OVER (ORDER BY {text_hash('row_id')}, row_id) - 1 AS sequence_id
  FROM ({identified(STAMPED, 'events')}))
SELECT event_id, user_id, event_type, sequence_id, {_event_uuid} AS uuid, TRUE AS has_utc,
       sequence_id AS index
FROM numbered""",
    "dedupe_key": "SELECT event_id, ts, event_type, value FROM events",
    "dense_index": f"""
SELECT {', '.join(LINEITEM)},
       row_number() OVER (ORDER BY {text_hash('row_id')}, row_id) - 1 AS index
FROM ({identified(LINEITEM, 'lineitem')})""",
    "ordered_index": """
SELECT event_type, ts, event_id,
       row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS index
FROM events""",
    "poisson_sample": f"""
SELECT event_id, value, k, user_id
FROM (SELECT *, unnest(range({repeats('u')})) AS draw
      FROM ({with_uniform(_events_by_id, 'event_id')}))""",
    "marginal_resample": f"WITH {_event_resample} SELECT * FROM synthetic",
    "marginal_resample_poisson": f"""
WITH {resampled(_event_long, 'event_id', EVENT_FEATURES, 'poisson', FRACTION)}
SELECT * FROM synthetic""",
    "marginal_resample_wide": f"""
WITH {resampled(_vector_long, 'vec_id', VECTOR, 'exact', 1.0)} SELECT * FROM synthetic""",
    "bootstrap_rows": f"""
WITH {covering_draws('SELECT *, 0 AS feature FROM (' + identified(ORDERED, 'orders') + ')',
                     'count(*)', None)},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY place_hash, row_hash, draw) - 1 AS sequence_id
  FROM ordered)
SELECT {', '.join(ORDERED)}, sequence_id
FROM numbered WHERE sequence_id < (SELECT m FROM rate)""",
    "replayed_draws": f"""
WITH indexed AS (
  SELECT {', '.join(STAMPED)},
         row_number() OVER (ORDER BY {text_hash('row_id')}, row_id) - 1 AS place
  FROM ({identified(STAMPED, 'events')})),
{covering_draws('SELECT *, 0 AS feature FROM indexed', 'count(*)', 'place')},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY place_hash, row_hash, draw) - 1 AS sequence_id
  FROM ordered)
SELECT {', '.join(STAMPED)}, sequence_id, {_event_uuid} AS uuid, place AS index
FROM numbered WHERE sequence_id < (SELECT m FROM rate)""",
    "contrast_set": f"""
WITH {_event_resample},
labelled AS (
  SELECT 1.0 AS label, value, CAST({EVENT_K} AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS user_id
  FROM events
  UNION ALL SELECT 0.0, value, k, user_id FROM synthetic)
SELECT CAST(label AS DOUBLE) AS label, count(*) AS rows, round(sum(value), 2) AS value_sum,
       sum(k) AS k_sum, sum(user_id) AS user_id_sum
FROM labelled GROUP BY label""",
    "anomaly_filter": "SELECT doc_id, quality, toxic FROM labels WHERE quality <= 0",
    "alerts_first5": f"""
SELECT event_id, ts, value, batch, '{ALERT_TEXT}' AS alert_text
FROM (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts, event_id) AS place
  FROM ({FLAGGED}) WHERE prediction <= 0)
WHERE place <= 5""",
    "batch_counts": f"""
SELECT batch, count(*) AS rows, count(*) FILTER (WHERE prediction <= 0) AS anomalies,
       FALSE AS empty
FROM ({FLAGGED}) GROUP BY batch""",
    "empty_counts": """
SELECT count(*) AS rows, count(*) AS anomalies, count(*) = 0 AS empty FROM events WHERE value < 0""",
    "stream_landing": """
SELECT event_id, replace(CAST(ts AS VARCHAR), ' ', 'T') AS utc, user_id, event_type, value,
       value + user_id AS total_bytes, 'site' || CAST(user_id % 2 AS VARCHAR) AS site
FROM events""",
    "stream_dedupe_state": """
SELECT count(*) AS keys FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 4 DAY""",
    "compact_date": f"""
WITH lines AS (
  SELECT concat_ws(' ', event_id, event_type, props) AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
         'site' || CAST(user_id % 2 AS VARCHAR) AS site
  FROM events),
size AS (
  SELECT greatest({LANDED_BYTES}, sum(strlen(value) + 1) // {LANDED_FILES}) AS file_bytes, max(date) AS last
  FROM lines),
landed AS (
  SELECT * FROM lines
  UNION ALL SELECT 'late ' || value, date, site FROM lines WHERE date = (SELECT last FROM size)),
folders AS (
  SELECT date, site, count(*) AS rows, sum(strlen(value) + 1) AS bytes FROM landed GROUP BY date, site),
counted AS (
  SELECT *, CAST(greatest(1, round(CAST(bytes AS DOUBLE) / file_bytes)) AS BIGINT) AS files
  FROM folders, size)
SELECT date, site, rows, files, CAST(0 AS BIGINT) AS large_files,
       CAST(bytes < 0.5 * file_bytes AS BIGINT) AS small_files,
       CASE WHEN date = last THEN files ELSE 0 END AS new_files
FROM counted""",
    "stream_alerts": f"""
WITH {PAIR_MESSAGES},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY slice ORDER BY line_id) AS place FROM scored WHERE vote = 0)
SELECT line_id, digit, triple, digit + triple AS total_bytes, '{ALERT_TEXT}' AS alert_text, slice AS batch
FROM placed WHERE place <= 5""",
    "stream_report": f"""
WITH {PAIR_MESSAGES}
SELECT slice AS batch, count(*) AS rows, count(*) FILTER (WHERE vote = 0) AS anomalies
FROM scored GROUP BY slice""",
    "forest_score": f"""
WITH {PAIR_MESSAGES}
SELECT source, count(*) AS rows, count(*) FILTER (WHERE vote = 0) AS soft_anomalies,
       count(*) FILTER (WHERE vote = 0) AS hard_anomalies
FROM scored GROUP BY source""",
    "site_scores": f"""
WITH {PAIR_MESSAGES}
SELECT 'site' || CAST(slice AS VARCHAR) AS site, count(*) AS rows,
       count(*) FILTER (WHERE vote = 0) AS anomalies, FALSE AS empty
FROM scored WHERE slice <> 1 GROUP BY slice""",
    "stream_enrich": """
SELECT event_id, replace(CAST(ts AS VARCHAR), ' ', 'T') AS utc, user_id, event_type, value,
       value + user_id AS total_bytes
FROM events""",
    "stream_dedupe": "SELECT event_id, event_type, value FROM events",
    "stream_max_batches": """
SELECT event_id, user_id, value FROM events,
  (SELECT min(event_id) AS low, max(event_id) AS high FROM events)
WHERE floor((event_id - low) * 4 / (high - low + 1)) < 2""",
    "landing_compact": """
SELECT event_id, replace(CAST(ts AS VARCHAR), ' ', 'T') AS utc, user_id, event_type, value,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'site' || CAST(user_id % 2 AS VARCHAR) AS site
FROM events""",
    "model_publish": f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE user_id % {PAIR_DIGITS} > 0) AS anomalies, '2' AS version
FROM events""",
    "scored_rows": f"""
WITH {PAIR_MESSAGES} SELECT line_id, digit, triple, vote AS soft, vote AS hard FROM scored""",
}
