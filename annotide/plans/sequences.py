"""Queries of order-dependent operators and of the sinks that gather a song's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators.stateful import absorb_short, greedy_match, split_by_pitch, state_notes, viterbi_segments
from annotide.plans.registry import query
from annotide.plans.windows import MASKS_SQL, SEG_SQL, grid_masks, label_segments
from annotide.sources.notes import NOTES_SQL, notes
from annotide.sources.sinks import song_projects, low_confidence

FRAMES_SQL = f"""{NOTES_SQL}, e AS (SELECT song_id, unnest(generate_series(0, 11)) AS pc, last FROM (SELECT song_id, max(end_ms) // 1000 AS last FROM n GROUP BY song_id)),
d AS (SELECT song_id, CAST(pc AS INTEGER) AS pc, unnest(generate_series(0, last)) AS i FROM e),
x AS (SELECT song_id, midi % 12 AS pc, start_ms // 1000 AS s, end_ms // 1000 AS f FROM n),
h AS (SELECT d.song_id, d.pc, d.i, bool_or(x.s = d.i) AS onset, bool_or(x.f = d.i) AS offset_, count(x.s) = 0 AS quiet FROM d LEFT JOIN x ON x.song_id = d.song_id AND x.pc = d.pc AND x.s <= d.i AND d.i <= x.f GROUP BY ALL),
q AS (SELECT song_id, pc, i, onset, first_value(CASE WHEN onset THEN i END IGNORE NULLS) OVER w AS nb, first_value(CASE WHEN quiet THEN i END IGNORE NULLS) OVER w AS d, first_value(CASE WHEN offset_ THEN i END IGNORE NULLS) OVER w AS o, max(i) OVER (PARTITION BY song_id, pc) AS last FROM h
 WINDOW w AS (PARTITION BY song_id, pc ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), r AS (SELECT *, least(i + 20, last) AS stop FROM q WHERE onset)"""


@query(f"""WITH {FRAMES_SQL} SELECT song_id, pc, i AS bgn, CASE WHEN nb <= least(coalesce(d, stop), stop) THEN nb - 1 WHEN d <= stop THEN CASE WHEN o <= d AND o - i > d - o THEN o ELSE d END ELSE stop END AS fin FROM r""")
def note_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each pitch class from dense frames of onsets, offsets and silence."""
    n = notes(spark, sf_dir)
    x = n.select("song_id", F.pmod("midi", F.lit(12)).alias("pc"), F.expr("start_ms div 1000").alias("s"), F.expr("end_ms div 1000").alias("f"))
    hit = x.withColumn("i", F.explode(F.sequence("s", "f"))).groupBy("song_id", "pc", "i").agg(F.bool_or(F.col("s") == F.col("i")).alias("onset"), F.bool_or(F.col("f") == F.col("i")).alias("offset"))
    dense = n.groupBy("song_id").agg(F.expr("max(end_ms) div 1000").alias("last")).select("song_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"), "last").select("song_id", "pc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("i"))
    frames = dense.join(hit, ["song_id", "pc", "i"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return state_notes(frames, ["song_id", "pc"], "i", flag("onset"), flag("offset"), F.col("onset").isNull(), cap=20)


TRIADS = [sum(1 << p for p in (root, (root + third) % 12, (root + 7) % 12)) for third in (4, 3) for root in range(12)]


@query(f"""WITH RECURSIVE {MASKS_SQL}, m AS (SELECT g.song_id, g.t, coalesce(mask, 0) AS mask, row_number() OVER (PARTITION BY g.song_id ORDER BY g.t) AS k FROM g LEFT JOIN hits h ON h.song_id = g.song_id AND h.t = g.t),
e AS (SELECT song_id, k, t, CASE WHEN (k - 1) % 4 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS cost, list_transform([{', '.join(map(str, TRIADS))}], lambda s: bit_count(mask & s) * 1.5::DOUBLE - bit_count(mask) * 0.5::DOUBLE) || [CASE WHEN mask = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END] AS em FROM m),
f AS (SELECT song_id, k, em AS score, [0::BIGINT] AS back FROM e WHERE k = 1
  UNION ALL SELECT e.song_id, e.k, list_transform(list_zip(f.score, e.em), lambda z: greatest(z[1], list_max(f.score) - e.cost) + z[2]), list_transform(f.score, lambda z, s: CASE WHEN z >= list_max(f.score) - e.cost THEN s ELSE list_position(f.score, list_max(f.score)) END)
  FROM f JOIN e ON e.song_id = f.song_id AND e.k = f.k + 1),
b AS (SELECT song_id, k, CAST(list_position(score, list_max(score)) AS BIGINT) AS s FROM f WHERE k = (SELECT max(k) FROM e WHERE e.song_id = f.song_id)
  UNION ALL SELECT f.song_id, f.k - 1, f.back[b.s] FROM b JOIN f ON f.song_id = b.song_id AND f.k = b.k WHERE f.k > 1)
SELECT b.song_id, e.t, CAST(s - 1 AS INTEGER) AS state FROM b JOIN e ON e.song_id = b.song_id AND e.k = b.k""")
def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothest sequence of triads under each song's pitch classes."""
    m = grid_masks(notes(spark, sf_dir)).withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    return viterbi_segments(m, "song_id", "t", "mask")


@query(f"""WITH RECURSIVE {SEG_SQL}, s AS (SELECT song_id, island, min(t) AS a, max(t) + 1000 AS z, any_value(label) AS label FROM isl GROUP BY song_id, island),
j AS (SELECT song_id, 0 AS step, min(a) AS begins, list(z - a ORDER BY a) AS ns, list(label ORDER BY a) AS ls FROM s GROUP BY song_id
  UNION ALL SELECT song_id, step + 1, begins, CASE WHEN lft IS NOT NULL AND rgt IS NOT NULL AND ls[pos - 1] = ls[pos + 1] THEN ns[1 : pos - 2] || [lft + m + rgt] || ns[pos + 2 : len(ns)] WHEN rgt IS NULL OR lft >= rgt THEN ns[1 : pos - 2] || [lft + m] || ns[pos + 1 : len(ns)] ELSE ns[1 : pos - 1] || [m + rgt] || ns[pos + 2 : len(ns)] END,
    CASE WHEN lft IS NOT NULL AND rgt IS NOT NULL AND ls[pos - 1] = ls[pos + 1] THEN ls[1 : pos - 1] || ls[pos + 2 : len(ls)] ELSE ls[1 : pos - 1] || ls[pos + 1 : len(ls)] END
  FROM (SELECT *, CASE WHEN pos > 1 THEN ns[pos - 1] END AS lft, ns[pos + 1] AS rgt FROM (SELECT *, list_min(ns) AS m, CAST(list_position(ns, list_min(ns)) AS BIGINT) AS pos FROM j) WHERE len(ns) > 1 AND m < 3000)),
o AS (SELECT song_id, begins, ns, ls, unnest(generate_series(1, len(ns))) AS i FROM j WHERE len(ns) <= 1 OR list_min(ns) >= 3000)
SELECT song_id, begins + CAST(list_sum(ns[1 : i]) AS BIGINT) - ns[i] AS start_ms, begins + CAST(list_sum(ns[1 : i]) AS BIGINT) AS end_ms, ls[i] AS label FROM o""")
def absorb_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label segments after those under 3 s have gone to their neighbours."""
    return absorb_short(label_segments(notes(spark, sf_dir)), "song_id", "start_ms", "end_ms", "label", 3000)


@query(f"""WITH RECURSIVE {NOTES_SQL}, x AS (SELECT song_id, midi % 12 AS pc, list({{'t': start_ms, 'id': note_id}} ORDER BY start_ms, note_id) FILTER (track = 'click') AS c, list({{'t': start_ms, 'id': note_id}} ORDER BY start_ms, note_id) FILTER (track = 'view') AS v FROM n GROUP BY ALL),
g AS (SELECT song_id, pc, c, v, 0 AS i, []::BIGINT[] AS used, NULL::BIGINT AS took FROM x WHERE c IS NOT NULL AND v IS NOT NULL
  UNION ALL SELECT song_id, pc, c, v, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best
  FROM (SELECT song_id, pc, c, v, i + 1 AS i, used, list_sort(list_filter(list_transform(v, lambda w, k: {{'d': abs(w.t - c[i + 1].t), 'k': k}}), lambda w: w.d <= 10000 AND NOT list_contains(used, w.k)))[1].k AS best FROM g WHERE i < len(c)))
SELECT song_id, CAST(pc AS BIGINT) AS pc, c[i].id AS left_id, v[took].id AS right_id, v[took].t - c[i].t AS dt FROM g WHERE took IS NOT NULL""")
def greedy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks matched one to one, in order, to the nearest free view of the same pitch class within 10 s."""
    n = notes(spark, sf_dir).withColumn("pc", F.pmod("midi", F.lit(12)))
    return greedy_match(n.where("track = 'click'"), n.where("track = 'view'"), "song_id", "pc", "start_ms", "note_id", 10_000)


@query(f"""WITH RECURSIVE {NOTES_SQL}, o AS (SELECT song_id, start_ms, min(midi)::DOUBLE AS midi FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_ms) AS i FROM o),
a AS (SELECT song_id, i, start_ms, 0 AS run, [midi] AS held FROM r WHERE i = 1
  UNION ALL SELECT song_id, i, start_ms, run + CAST(new AS INTEGER), CASE WHEN new THEN [midi] ELSE list_append(held, midi)[-16:] END FROM (SELECT r.*, a.run, a.held, abs(r.midi - list_aggregate(a.held, 'median')) > 7 AS new FROM a JOIN r ON r.song_id = a.song_id AND r.i = a.i + 1))
SELECT song_id, start_ms, run FROM a""")
def pitch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets of each song in order, cut where the pitch leaves the running median by more than a fifth."""
    n = notes(spark, sf_dir).groupBy("song_id", "start_ms").agg(F.min("midi").alias("midi"))
    return split_by_pitch(n, "song_id", "start_ms", "midi", 7.0)


@query(f"""WITH {SEG_SQL}, s AS (SELECT song_id, island, min(t) AS start_ms, max(t) + 1000 AS end_ms, any_value(label) AS label, count(*) AS frames FROM isl GROUP BY song_id, island)
SELECT song_id, count(*) AS rows, min(start_ms) AS first, string_agg(label, '|' ORDER BY start_ms) AS labels FROM s WHERE label <> 'N' GROUP BY song_id""")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline that a song's project file holds, in order."""
    p = song_projects(label_segments(notes(spark, sf_dir)).withColumn("conf", F.lit(1.0)), bpm=120)
    rows = F.from_json(F.get_json_object("project", "$.timeline"), "array<struct<time:double,chord:string>>")
    p = p.select("song_id", rows.alias("r"))
    return p.select("song_id", F.size("r").cast("long").alias("rows"), F.round(F.element_at("r", 1)["time"] * 1000).cast("long").alias("first"), F.array_join(F.transform("r", lambda x: x["chord"]), "|").alias("labels"))


@query(f"""WITH {SEG_SQL}, s AS (SELECT song_id, min(t) AS start_ms, any_value(label) AS label, count(*) AS frames FROM isl GROUP BY song_id, island),
c AS (SELECT *, round(frames / (frames + 1.0::DOUBLE), 6) AS conf FROM s WHERE label <> 'N'), r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY conf, start_ms) AS rn FROM c WHERE conf < 0.6)
SELECT song_id, CAST(rn AS INTEGER) AS rank, start_ms, label, conf FROM r WHERE rn <= 40""")
def worst_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 segments of each song below a confidence, the least sure first."""
    s = label_segments(notes(spark, sf_dir)).withColumn("conf", F.round(F.col("frames") / (F.col("frames") + 1.0), 6))
    return low_confidence(s.where("label <> 'N'"), below=0.6, k=40).select("song_id", "rank", "start_ms", "label", "conf")
