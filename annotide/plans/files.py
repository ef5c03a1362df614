"""Sources and sinks there and back, and set, grouping and ranking operators as queries of their own.

Files go to a folder of their own below the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.plans.registry import query
from annotide.sources.midi import events_of_files, note_rows
from annotide.sources.notes import NOTES_SQL, notes, table
from annotide.sources.readers import pasted_chords, read_chord_tokens, read_epochs, read_keyed_json
from annotide.sources.sinks import midi_files, reports
from annotide.streaming.events import shared_folder


@query(f"""WITH {NOTES_SQL}, q AS (SELECT song_id, midi, CAST(40 + amp % 88 AS INTEGER) AS velocity, CAST(round(start_ms * 1000 * 480 / 500000.0::DOUBLE) AS BIGINT) AS a, CAST(round(end_ms * 1000 * 480 / 500000.0::DOUBLE) AS BIGINT) AS z FROM n),
o AS (SELECT *, greatest(z, a + 1) AS off FROM q), s AS (SELECT song_id, midi, a, velocity, row_number() OVER (PARTITION BY song_id, midi ORDER BY a, velocity) AS k FROM o), f AS (SELECT song_id, midi, off, row_number() OVER (PARTITION BY song_id, midi ORDER BY off) AS k FROM o)
SELECT s.song_id, s.midi, s.velocity, CAST(round(a * 500000 / 480.0::DOUBLE) AS BIGINT) AS start_us, CAST(round(off * 500000 / 480.0::DOUBLE) AS BIGINT) AS end_us FROM s JOIN f USING (song_id, midi, k)""")
def midi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs written as MIDI files and read again: times on the grid of ticks, ends matched to starts in order."""
    n = notes(spark, sf_dir).withColumn("velocity", (40 + F.col("amp") % 88).cast("int"))
    files = midi_files(n).select(F.col("song_id").cast("string").alias("path"), "content")
    got = note_rows(events_of_files(files))
    return got.select(F.col("path").cast("long").alias("song_id"), "midi", "velocity", "start_us", "end_us")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey AS nation, round(s_acctbal, 2) AS balance FROM supplier""")
def keyed_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects keyed by id, a gzip file for each nation, exploded into rows."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("s_nationkey").cast("long").alias("nation"), F.round("s_acctbal", 2).alias("balance")).alias("v"))
    files = s.groupBy(F.col("v.nation").alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "v")))).alias("value"))
    at = shared_folder(spark, "json")
    files.write.partitionBy("file").option("compression", "gzip").text(at)
    return read_keyed_json(spark, at, "nation long, balance double").select("id", "nation", "balance")


@query("""SELECT o_orderkey, CAST(i - 1 AS BIGINT) AS pos, ['C', 'Dmin', 'G7', 'Amin7'][(o_orderkey + i) % 4 + 1] AS token FROM orders, LATERAL (SELECT unnest(generate_series(1, 1 + o_orderkey % 3)) AS i)""")
def chord_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists from CSV files, with their section marks gone and the places of the tokens."""
    names = F.array(*map(F.lit, ("C", "Dmin", "G7", "Amin7")))
    tokens = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("o_orderkey") % 3), lambda i: F.get(names, ((F.col("o_orderkey") + i) % 4).cast("int")))
    at = shared_folder(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<verse> "), F.array_join(tokens, " <x>  ")).alias("chords")).write.option("header", True).csv(at)
    got = read_chord_tokens(spark, at)
    return got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("pos").cast("long").alias("pos"), "token")


@query("""SELECT CAST(c_custkey AS INTEGER) AS epoch, (c_custkey % 1000) / 1000.0::DOUBLE AS val_acc FROM customer""")
def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs and accuracies from the lines of training logs."""
    c = table(spark, sf_dir, "customer")
    line = F.format_string("EPOCH %d loss 0.5 val_acc %.3f", "c_custkey", (F.col("c_custkey") % 1000) / 1000.0)
    at = shared_folder(spark, "log")
    c.select(F.explode(F.array(F.lit("saved"), line)).alias("value")).write.text(at)
    return read_epochs(spark, at).select("epoch", "val_acc")


@query("""SELECT p_partkey AS song_id, CAST((turn * 3 + pos) * 2 AS INTEGER) AS beat, ['Am', 'F', 'G7'][CAST(pos + 1 AS BIGINT)] AS chord FROM part, LATERAL (SELECT unnest(generate_series(0, 1)) AS turn), LATERAL (SELECT unnest(generate_series(0, 2)) AS pos)""")
def chord_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of pasted texts, two beats each, twice over; other words are passed over."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("song_id"), F.concat(F.lit("Verse: Am, F | "), "p_name", F.lit(" G7")).alias("text"))
    return pasted_chords(texts, beats_per_chord=2, times=2)


@query(f"""WITH {NOTES_SQL}, s AS (SELECT song_id, start_ms, track AS label, round(amp / 100.0::DOUBLE, 2) AS conf, note_id FROM n)
SELECT song_id, count(*) + greatest(count(*) FILTER (conf < 0.45), 1) + 10 AS lines, count(*) FILTER (conf < 0.45) AS unsure FROM s GROUP BY song_id""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each song's report, and those of its unsure part."""
    s = notes(spark, sf_dir).select("song_id", "start_ms", F.col("track").alias("label"), F.round(F.col("amp") / 100.0, 2).alias("conf"))
    lines = F.split("report", "\n")
    unsure = F.size(F.filter(F.slice(lines, 1, F.array_position(lines, "## All") - 1), lambda x: x.rlike(r"^\| [0-9]")))
    return reports(s).select("song_id", F.size(lines).cast("long").alias("lines"), unsure.cast("long").alias("unsure"))


@query(f"""WITH {NOTES_SQL} SELECT note_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS quarter, round(percent_rank() OVER w, 9) AS percent, round(cume_dist() OVER w, 9) AS cume, nth_value(note_id, 2) OVER (PARTITION BY song_id ORDER BY start_ms, note_id) AS second FROM n WINDOW w AS (PARTITION BY song_id ORDER BY amp)""")
def rank_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, order = Window.partitionBy("song_id").orderBy("amp"), Window.partitionBy("song_id").orderBy("start_ms", "note_id")
    n = notes(spark, sf_dir)
    return n.select("note_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(order).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("percent"), F.round(F.cume_dist().over(w), 9).alias("cume"), F.nth_value("note_id", 2).over(order).alias("second"))


@query(f"""WITH {NOTES_SQL} SELECT track, midi % 12 AS pc, count(*) AS notes, count(DISTINCT song_id) AS songs, grouping(track) + 2 * grouping(midi % 12) AS level FROM n GROUP BY CUBE (track, midi % 12)""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).withColumn("pc", F.pmod("midi", F.lit(12)))
    return n.cube("track", "pc").agg(F.count("*").alias("notes"), F.countDistinct("song_id").alias("songs"), (F.grouping("track") + 2 * F.grouping("pc")).cast("long").alias("level"))


@query(f"""WITH {NOTES_SQL}, a AS (SELECT song_id, midi FROM n WHERE track = 'click'), b AS (SELECT song_id, midi FROM n WHERE track = 'view')
SELECT 'union' AS op, song_id, midi FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect all', song_id, midi FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'except all', song_id, midi FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'except', song_id, midi FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    a, b = (n.where(F.col("track") == t).select("song_id", "midi") for t in ("click", "view"))
    named = {"union": a.union(b).distinct(), "intersect all": a.intersectAll(b), "except all": a.exceptAll(b), "except": a.subtract(b)}
    out = None
    for name, df in named.items():
        df = df.select(F.lit(name).alias("op"), "song_id", "midi")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS newest, coalesce(any_value(c_mktsegment), 'default') AS setting, strftime(max(o_orderdate), '%Y-%m') AS month FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 GROUP BY o_custkey""")
def newest_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, and a setting with a default where none is given."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("month"))
    return newest.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_custkey", "newest", F.coalesce("c_mktsegment", F.lit("default")).alias("setting"), "month")
