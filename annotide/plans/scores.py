"""Queries of scores and MIDI files there and back, and of Spark's extension points: a data source, a table function, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.dims import LETTER_PC, TEMPLATES, values_sql
from annotide.functions import table_functions
from annotide.operators.harmony import best_chords
from annotide.plans.edges import PEDAL_SQL, pedal_controls
from annotide.plans.harmony import RANKED_SQL, song_masks
from annotide.plans.registry import query
from annotide.sources import midi_source
from annotide.sources.midi import events_of_files
from annotide.sources.musicxml import read_musicxml, rebarred, score_texts
from annotide.sources.notes import NOTES_SQL, notes, table
from annotide.sources.sinks import chord_notes, note_events, song_files, sustain_events
from annotide.streaming.events import shared_folder


@query(f"""WITH {NOTES_SQL}, x AS (SELECT song_id, (k - 1) // 5 AS measure, (k - 1) % 5 AS seq, CASE WHEN note_id % 7 > 0 THEN midi END AS midi, note_id % 7 > 0 AND note_id % 5 = 0 AND (k - 1) % 5 > 0 AS chord, (1 + amp % 6) / 4.0::DOUBLE AS length FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS k FROM n)),
y AS (SELECT *, coalesce(sum(CASE WHEN NOT chord THEN length END) OVER w, 0) - CASE WHEN chord THEN coalesce(last_value(CASE WHEN NOT chord THEN length END IGNORE NULLS) OVER w, 0) ELSE 0 END AS onset FROM x WINDOW w AS (PARTITION BY song_id, measure ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, greatest(least(onset + length, 3) - onset, 0.125) AS cut, max(onset) OVER (PARTITION BY song_id, measure) AS last FROM y WHERE onset < 3)
SELECT song_id, CAST(measure AS INTEGER) AS measure, CAST(seq AS INTEGER) AS seq, measure * 3 + onset AS at, CASE WHEN onset = last AND midi IS NOT NULL THEN greatest(3 - onset, cut) ELSE cut END AS length, midi FROM z""")
def rebarred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs written as MusicXML, five elements a measure, read again and brought to bars of three quarters."""
    w = Window.partitionBy("song_id").orderBy("start_ms", "note_id")
    k = F.row_number().over(w) - 1
    n = notes(spark, sf_dir).withColumn("k", k)
    sounds = F.col("note_id") % 7 > 0
    e = n.select(F.col("song_id").cast("string").alias("part"), F.expr("cast(k div 5 as int)").alias("measure"), (F.col("k") % 5).alias("seq"), F.when(sounds, F.col("midi")).alias("midi"), (sounds & (F.col("note_id") % 5 == 0) & (F.col("k") % 5 > 0)).alias("chord"), (1 + F.col("amp") % 6).alias("duration"))
    at = shared_folder(spark, "musicxml")
    score_texts(e, 4).withColumnRenamed("part", "song").write.partitionBy("song").text(at)
    got = rebarred(read_musicxml(spark, at), 3, 4)
    return got.select(F.col("part").cast("long").alias("song_id"), "measure", "seq", "at", "length", "midi")


TICKS_SQL = "CAST(round({0} * 0.96e0) AS BIGINT)"


@query(f"""WITH RECURSIVE {PEDAL_SQL}, m AS (SELECT song_id, CASE track WHEN 'click' THEN 1 ELSE 3 END AS track, {TICKS_SQL.format("start_ms")} AS s, {TICKS_SQL.format("end_ms")} AS e, midi, 40 + amp % 80 AS velocity FROM n WHERE track IN ('click', 'view')),
mo AS (SELECT song_id, track, s, CASE WHEN e <= s THEN s + 120 ELSE e END AS e, midi, velocity FROM m), mp AS (SELECT song_id, i, fin FROM s WHERE fin IS NOT NULL),
mq AS (SELECT song_id, track, 'on' AS kind, s AS tick, midi AS a, velocity AS b FROM mo UNION ALL SELECT song_id, track, 'off', e, midi, 0 FROM mo UNION ALL SELECT song_id, 2, 'control', i * 480, 64, 127 FROM mp UNION ALL SELECT song_id, 2, 'control', fin * 480, 64, 0 FROM mp UNION ALL SELECT DISTINCT song_id, 0, 'tempo', 0, 500000, 0 FROM n)
SELECT song_id, CAST(track AS INTEGER) AS track, kind, CAST(tick AS BIGINT) AS tick, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM mq""")
def midi_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs as MIDI files with a track for clicks, one for views and one for the pedal, and the events read from them."""
    n = notes(spark, sf_dir).withColumn("velocity", 40 + F.col("amp") % 80)
    played = note_events(n.where("track in ('click', 'view')"), F.when(F.col("track") == "click", "a").otherwise("c"))
    pedal = sustain_events(pedal_controls(spark, sf_dir), F.lit("b"))
    files = song_files(played.unionByName(pedal)).select(F.col("song_id").cast("string").alias("path"), "content")
    got = events_of_files(files)
    return got.select(F.col("path").cast("long").alias("song_id"), "track", "kind", "tick", "a", "b")


@query(f"""WITH {RANKED_SQL}, iv AS (SELECT * FROM (VALUES {values_sql((s, v) for s, ivs in TEMPLATES for v in ivs)}) v(sfx, iv)), c AS (SELECT h.song_id, h.t, root, rk.sfx, CAST(greatest(least(trunc(40 + 70 * (least(greatest(score, 0), 12) / 12e0)), 127), 1) AS INTEGER) AS velocity FROM hits h JOIN rk ON rk.mask = h.mask AND rank = 1),
p AS (SELECT song_id, t, velocity, 48 + root + iv AS midi FROM c JOIN iv USING (sfx) UNION SELECT song_id, t, velocity, 36 + root FROM c)
SELECT song_id, kind, CAST(CASE WHEN kind = 'on' THEN t * 0.96e0 ELSE (t + 1000) * 0.96e0 END AS BIGINT) AS tick, CAST(midi AS INTEGER) AS a, CASE WHEN kind = 'on' THEN velocity ELSE 0 END AS b FROM p, (SELECT unnest(['on', 'off']) AS kind)""")
def chord_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chord of every second as a block chord over its root in the bass, louder where its score is higher, in
    MIDI files; the events read from them."""
    best = best_chords(song_masks(notes(spark, sf_dir)), 1, how="inner")
    ivs = F.create_map(*(x for s, v in TEMPLATES for x in (F.lit(s), F.array(*map(F.lit, v)))))
    voicing = F.concat(F.array(F.col("root") + 36), F.transform(F.element_at(ivs, F.col("sfx")), lambda v: v + F.col("root") + 48))
    s = best.select("song_id", F.col("t").alias("start_ms"), (F.col("t") + 1000).alias("end_ms"), F.lit("chord").alias("label"), (F.least(F.greatest("score", F.lit(0.0)), F.lit(12.0)) / 12).alias("conf"), "root", "sfx")
    files = song_files(note_events(chord_notes(s, voicing), F.lit("chords"))).select(F.col("song_id").cast("string").alias("path"), "content")
    return events_of_files(files).where("kind <> 'tempo'").select(F.col("path").cast("long").alias("song_id"), "kind", "tick", "a", "b")


@query(f"""WITH {NOTES_SQL} SELECT song_id, CAST(1 + note_id % 2 AS INTEGER) AS track, kind, CASE WHEN kind = 'on' THEN start_ms ELSE end_ms END AS tick, midi AS a, CAST(CASE WHEN kind = 'on' THEN 64 ELSE 0 END AS INTEGER) AS b FROM n, (SELECT unnest(['on', 'off']) AS kind)
UNION ALL SELECT DISTINCT song_id, 0, 'tempo', 0, 400000, 0 FROM n""")
def midi_source_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written and read by the data source for MIDI folders."""
    midi_source.register(spark)
    n = notes(spark, sf_dir)
    path = F.concat(F.lit("songs/"), F.col("song_id").cast("string"), F.lit(".mid"))
    event = lambda kind, t, b: F.struct(F.lit(kind).alias("kind"), F.col(t).alias("tick"), F.lit(b).alias("b"))
    played = n.select(path.alias("path"), (1 + F.col("note_id") % 2).cast("int").alias("track"), F.col("midi").alias("a"), F.explode(F.array(event("on", "start_ms", 64), event("off", "end_ms", 0))).alias("e")).select("path", "track", "e.kind", "e.tick", "a", "e.b")
    tempo = n.select("song_id").distinct().select(path.alias("path"), F.lit(0).alias("track"), F.lit("tempo").alias("kind"), F.lit(0).cast("long").alias("tick"), F.lit(400_000).alias("a"), F.lit(0).alias("b"))
    events = played.unionByName(tempo).select("path", F.lit(480).alias("ticks_per_beat"), "track", F.lit(0).alias("seq"), "tick", "kind", F.lit(0).alias("channel"), "a", "b")
    at = shared_folder(spark, "midi")
    events.repartition("path").sortWithinPartitions("path", "track", "tick", "kind", "a").write.format("midi").mode("append").save(at)
    got = spark.read.format("midi").option("mode", "failfast").load(at)
    return got.select(F.regexp_extract("path", r"(\d+)\.mid$", 1).cast("long").alias("song_id"), "track", "kind", "tick", "a", "b")


@query(f"WITH {RANKED_SQL} SELECT mask, rank, CAST(root AS INTEGER) AS root, sfx, score FROM rk WHERE rank <= 5")
def chord_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function for chord candidates in SQL, with LATERAL."""
    table_functions.register(spark)
    masks = song_masks(notes(spark, sf_dir)).select("mask").distinct()
    return spark.sql("SELECT m.mask, CAST(c.rank AS BIGINT) AS rank, c.root, c.sfx, c.score FROM {m} m, LATERAL chord_candidates(m.mask, 5) c", m=masks)


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS d, user_id, event_id FROM events)
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS ids, count(DISTINCT d) AS days, true AS close FROM d GROUP BY event_type""")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and events of each type from sketches by day that are merged above it; close says whether both are
    within four standard errors (0.81 % of the count each, at 2^14 buckets) of the exact numbers, which come out."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.hll_sketch_agg("user_id", 14).alias("u"), F.hll_sketch_agg("event_id", 14).alias("i"))
    merged = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("u")).alias("about_users"), F.hll_sketch_estimate(F.hll_union_agg("i")).alias("about_ids"), F.count("*").alias("days"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("ids"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) * 4 * 0.0081, F.lit(1.0))
    return merged.join(exact, "event_type").select("event_type", "users", "ids", "days", (near("about_users", "users") & near("about_ids", "ids")).alias("close"))


#: Words of a key's mode in another language, in front of which no blank is needed.
MODE_WORDS = [("大调", " Major"), ("小调", " Minor")]
ROOTS = {f"{x}{a}": (pc + d) % 12 for x, pc in LETTER_PC.items() for a, d in (("", 0), ("#", 1), ("b", -1))}


@query(f"""WITH r AS (SELECT * FROM (VALUES {values_sql(ROOTS.items())}) v(name, pc)), k AS (SELECT c_custkey, ['C', 'Eb', 'F#', 'Bb', 'H', 'c'][c_custkey % 6 + 1] || ['', ' Major', ' minor', '大调', '小调', '  Min'][c_custkey // 6 % 6 + 1] AS key FROM customer),
p AS (SELECT c_custkey, key, regexp_extract_all(replace(replace(key, '大调', ' Major'), '小调', ' Minor'), '[^ ]+') AS w FROM k)
SELECT c_custkey, key, CAST(pc AS INTEGER) AS tonic, CASE WHEN pc IS NULL THEN NULL WHEN starts_with(lower(w[2]), 'min') THEN 'min' ELSE 'maj' END AS mode FROM p LEFT JOIN r ON r.name = w[1]""")
def key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonic and mode of keys as people write them; null where the root is none."""
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    key = F.concat(pick(["C", "Eb", "F#", "Bb", "H", "c"], F.col("c_custkey") % 6), pick(["", " Major", " minor", "大调", "小调", "  Min"], F.expr("c_custkey div 6 % 6")))
    k = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    plain = F.col("key")
    for word, means in MODE_WORDS:
        plain = F.replace(plain, F.lit(word), F.lit(means))
    w = F.split(F.trim(plain), " +")
    tonic = F.try_element_at(F.create_map(*(F.lit(x) for kv in ROOTS.items() for x in kv)), F.get(w, 0)).cast("int")
    mode = F.when(F.coalesce(F.lower(F.get(w, 1)).startswith("min"), F.lit(False)), "min").otherwise("maj")
    return k.select("c_custkey", "key", tonic.alias("tonic"), F.when(tonic.isNotNull(), mode).alias("mode"))


@query(f"""WITH {NOTES_SQL} SELECT note_id, count(*) OVER w AS near, CAST(sum(amp) OVER w AS BIGINT) AS weight, count(*) OVER (PARTITION BY song_id ORDER BY start_ms // 4000 GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS grouped FROM n WINDOW w AS (PARTITION BY song_id ORDER BY start_ms RANGE BETWEEN 2000 PRECEDING AND 500 FOLLOWING)""")
def range_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from 2 s before to half a second after each, as a frame by value, and those of a group of 4 s and the group
    before it, which is a frame by the rank of the group."""
    n = notes(spark, sf_dir).withColumn("g", F.dense_rank().over(Window.partitionBy("song_id").orderBy(F.expr("start_ms div 4000"))))
    w = Window.partitionBy("song_id").orderBy("start_ms").rangeBetween(-2000, 500)
    return n.select("note_id", F.count("*").over(w).alias("near"), F.sum("amp").over(w).cast("long").alias("weight"), F.count("*").over(Window.partitionBy("song_id").orderBy("g").rangeBetween(-1, 0)).alias("grouped"))
