"""Every query of the library by name, and the SQL that must agree with it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.staging import drop_path, shared_dir, stage
from ..operators import bytesdiff, campaigns, chapters, detect, graph, intervals, inverted, queues, sequence, text, tiers
from ..sources import feeds as fs
from ..sources import store as st
from ..streaming import delta
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(*parts: str):
    """Register a query under its function's name; the parts are views and a final SELECT in SQL, or nothing."""

    def put(f: Query) -> Query:
        name = f.__name__
        _queries[name] = f
        if parts:
            _sql[name] = ("WITH " + ",\n".join(parts[:-1]) + "\n" if parts[:-1] else "") + parts[-1]
        return f

    return put


def once(*parts: str) -> tuple[str, ...]:
    """The same views, each computed once however often it is named."""
    return tuple(re.sub(r"(^|\),\s*)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", p) for p in parts)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


T = V.table
ISLANDS = "SELECT {k}, {p}, sum(n) OVER (PARTITION BY {k} ORDER BY {p}) AS run FROM (SELECT {k}, {p}, CASE WHEN {p} - lag({p}) OVER (PARTITION BY {k} ORDER BY {p}) <= {g} THEN 0 ELSE 1 END AS n FROM {t})"

# ------------------------------------------------------------------ text tier


@query(f"SELECT doc_id, len({V.WORDS.format(t='text')}) AS words, array_to_string({V.WORDS.format(t='text')}, ' ') AS plain FROM documents")
def normalize_words(spark, sf):
    w = S.normalize_words(F.col("text"))
    return T(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.array_join(w, " ").alias("plain"))


@query(V.SEG, V.SEGW, V.GRAMS, "SELECT episode_id, seg_idx, shingle FROM grams")
def shingles(spark, sf):
    return text.shingled(V.segments(spark, sf), ["episode_id", "seg_idx"])


@query(V.SEG, V.SEGW, V.GRAMS, V.LIB, V.RATIO, "SELECT episode_id, seg_idx, grams, hits, ratio FROM ratio")
def containment_ratio(spark, sf):
    return text.containment(V.segments(spark, sf), V.library(spark, sf), ["episode_id", "seg_idx"])


RUNS = "hit AS (SELECT episode_id, seg_idx FROM ratio WHERE ratio >= 0.4)", "isl AS (" + ISLANDS.format(k="episode_id", p="seg_idx", g=3, t="hit") + ")", 'runs AS (SELECT episode_id, min(seg_idx) AS "first", max(seg_idx) AS "last" FROM isl GROUP BY episode_id, run)'


@query(V.SEG, V.SEGW, V.GRAMS, V.LIB, V.RATIO, *RUNS, """SELECT r.episode_id, r."first", r."last", a."start", b."end", 'repeat' AS source FROM runs r JOIN seg a ON a.episode_id = r.episode_id AND a.seg_idx = r."first" JOIN seg b ON b.episode_id = r.episode_id AND b.seg_idx = r."last" """)
def repeat_detect(spark, sf):
    return text.repeat_detect(V.segments(spark, sf), V.library(spark, sf))


@query(V.SEG, V.SPANS, V.SEGW, V.GRAMS, """SELECT DISTINCT g.shingle FROM grams g JOIN seg s USING (episode_id, seg_idx) WHERE EXISTS (SELECT 1 FROM spans x WHERE x.episode_id = s.episode_id AND x.source IN ('chapter', 'llm', 'manual') AND s."end" > x."start" AND s."start" < x."end")""")
def text_library(spark, sf):
    return text.text_library(V.segments(spark, sf), V.spans(spark, sf))


# ------------------------------------------------------------------ intervals

MERGED = """mk AS (SELECT user_id, "start", "end", CASE WHEN "start" <= max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM tl),
mr AS (SELECT user_id, "start", "end", sum(n) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM mk),
merged AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM mr GROUP BY user_id, run)"""


@query(V.TIMELINE, MERGED, 'SELECT user_id, "start", "end" FROM merged')
def merge_spans(spark, sf):
    return intervals.merge_spans(V.timeline(spark, sf), ["user_id"])


DAY = 86_400_000_000


def _day(spark, sf):
    tl = V.timeline(spark, sf).withColumns({"start": F.col("start") % DAY, "end": F.col("start") % DAY + F.col("end") - F.col("start")})
    return tl, tl.select("user_id").distinct().withColumn("duration", F.lit(DAY))


DAYTL = V.TIMELINE.replace("tl AS", "tl0 AS"), f"""tl AS (SELECT event_id, user_id, "start" % {DAY} AS "start", least("start" % {DAY} + "end" - "start", {DAY}) AS "end", source FROM tl0 WHERE "end" > "start")"""
KEEP = f"""edges AS (SELECT user_id, "start", "end" FROM merged UNION ALL SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM tl0),
keeps AS (SELECT user_id, "end" AS "start", coalesce(lead("start") OVER (PARTITION BY user_id ORDER BY "start"), {DAY}) AS "end" FROM edges)"""


@query(*DAYTL, MERGED, KEEP, 'SELECT user_id, "start", "end" FROM keeps WHERE "end" > "start"')
def keep_spans(spark, sf):
    tl, days = _day(spark, sf)
    return intervals.keep_spans(tl, days, "user_id")


@query(*DAYTL, MERGED, KEEP, f"""SELECT user_id, CAST({DAY} AS BIGINT) AS duration, CAST({DAY} - sum("end" - "start") AS BIGINT) AS ad_seconds, ({DAY} - sum("end" - "start")) / CAST({DAY} AS DOUBLE) > 0.35 AS anomalous FROM keeps WHERE "end" > "start" GROUP BY user_id""")
def cut_plan(spark, sf):
    tl, days = _day(spark, sf)
    return intervals.with_anomaly(intervals.ad_seconds(intervals.keep_spans(tl, days, "user_id"), days, "user_id"))


@query(*DAYTL, MERGED, KEEP, f"""g AS (SELECT user_id, "start", least(60000000, "end" - "start") AS l FROM keeps WHERE "end" - "start" >= 10000000)""", """t AS (SELECT user_id, "start", least(l, 180000000 - coalesce(sum(l) OVER (PARTITION BY user_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM g)""", 'SELECT user_id, "start", CAST("start" + t AS BIGINT) AS "end" FROM t WHERE t >= 10000000')
def gap_windows(spark, sf):
    tl, days = _day(spark, sf)
    return intervals.gap_windows(intervals.keep_spans(tl, days, "user_id"), "user_id", 180_000_000, 60_000_000, 10_000_000)


SNAPPED = """c AS (SELECT * FROM spans WHERE source IN ('chapter', 'llm', 'manual', 'repeat', 'fpmatch')), e AS (SELECT episode_id, unnest(["start", "end"]) AS edge FROM spans WHERE source = 'recur'),
m AS (SELECT c.id, min(CASE WHEN edge BETWEEN c."start" AND c."start" + 2.5 THEN edge END) AS s, max(CASE WHEN edge BETWEEN c."end" - 2.5 AND c."end" THEN edge END) AS e FROM c JOIN e ON e.episode_id = c.episode_id GROUP BY c.id),
sn AS (SELECT c.id AS span_id, c.episode_id, CASE WHEN coalesce(m.e, c."end") > coalesce(m.s, c."start") THEN coalesce(m.s, c."start") ELSE c."start" END AS "start", CASE WHEN coalesce(m.e, c."end") > coalesce(m.s, c."start") THEN coalesce(m.e, c."end") ELSE c."end" END AS "end" FROM c LEFT JOIN m ON m.id = c.id)"""


@query(V.SPANS, SNAPPED, 'SELECT span_id, episode_id, "start", "end" FROM sn')
def snap_inward(spark, sf):
    s = V.spans(spark, sf)
    cut = s.where(F.col("source").isin(*S.CUT_SOURCES)).select(F.col("id").alias("span_id"), "episode_id", "start", "end")
    return intervals.snap_inward(cut, s.where("source = 'recur'"), "episode_id")


@query(V.SEG, V.SPANS, 'SELECT s.episode_id, s.seg_idx, x.id AS span_id, x.source FROM seg s JOIN spans x ON x.episode_id = s.episode_id AND s."end" > x."start" AND s."start" < x."end"')
def overlap_join(spark, sf):
    return intervals.overlap_join(V.segments(spark, sf), V.spans(spark, sf), "episode_id", bucket=60.0).select("episode_id", "seg_idx", F.col("id").alias("span_id"), "source")


@query(V.SEG, V.SPANS, 'SELECT s.episode_id, s.seg_idx FROM seg s WHERE EXISTS (SELECT 1 FROM spans x WHERE x.episode_id = s.episode_id AND s."end" > x."start" AND s."start" < x."end")')
def covered_segments(spark, sf):
    return intervals.covered_segments(V.segments(spark, sf), V.spans(spark, sf)).select("episode_id", "seg_idx")


SPOKEN = """w AS (SELECT episode_id, "start", "end", len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM seg WHERE episode_id IN (SELECT id FROM episodes WHERE transcript_path IS NOT NULL))"""


def _spoken(spark, sf):
    """The lines of documents with a transcript."""
    told = V.episodes(spark, sf).where("transcript_path is not null").select(F.col("id").alias("episode_id"))
    return V.segments(spark, sf).join(told, "episode_id", "left_semi")


@query(V.SEG, V.SPANS, V.EPISODES, SPOKEN, """t AS (SELECT x.id, x.episode_id, coalesce(sum(w.n), 0) AS words FROM spans x LEFT JOIN w ON w.episode_id = x.episode_id AND w."end" > x."start" AND w."start" < x."end" GROUP BY ALL)""", "SELECT id, episode_id FROM t WHERE words >= 5 OR episode_id NOT IN (SELECT episode_id FROM w)")
def speech_filter(spark, sf):
    return intervals.speech_filter(V.spans(spark, sf), _spoken(spark, sf)).select("id", "episode_id")


@query(V.SEG, "h AS (SELECT DISTINCT episode_id, seg_idx FROM seg WHERE length(text) >= 60)", "isl AS (" + ISLANDS.format(k="episode_id", p="seg_idx", g=3, t="h") + ")", 'SELECT episode_id, min(seg_idx) AS "first", max(seg_idx) AS "last", count(*) AS members FROM isl GROUP BY episode_id, run HAVING max(seg_idx) - min(seg_idx) + 1 >= 3')
def group_runs(spark, sf):
    return intervals.group_runs(V.segments(spark, sf).where(F.length("text") >= 60), ["episode_id"], "seg_idx", 2, 3)


# ------------------------------------------------------------------ sequence tier

N = "n AS (SELECT count(DISTINCT episode_id) AS n FROM fr)"
STOP = "st AS (SELECT value, count(DISTINCT episode_id) AS episodes FROM fr GROUP BY value HAVING count(DISTINCT episode_id) > {f} * (SELECT n FROM n))"


@query(V.FRAMES, "SELECT episode_id, frame, value FROM fr")
def value_frames(spark, sf):
    return V.doc_frames(spark, sf)


@query(V.FRAMES, N, STOP.format(f=0.05), "SELECT value, episodes FROM st")
def doc_frequency_stop(spark, sf):
    return sequence.frequent_values(V.doc_frames(spark, sf), 0.05)


@query(V.FRAMES, N, STOP.format(f=0.02), "ed AS (SELECT DISTINCT value FROM fr WHERE episode_id % 3 = 0)", "SELECT st.value FROM st WHERE st.value IN (SELECT value FROM ed)")
def editorial_veto(spark, sf):
    f = V.doc_frames(spark, sf)
    return sequence.stop_values(sequence.frequent_values(f, 0.02), f.where("episode_id % 3 = 0"))


VOTES = "pr AS (SELECT q.episode_id, q.frame, l.episode_id AS other, l.frame AS other_frame FROM fr q JOIN lf l ON l.value = q.value)", 'vt AS (SELECT episode_id, other, frame - other_frame AS "offset", count(*) AS votes FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 20)'


@query(V.FRAMES, V.LIBFRAMES, *VOTES, 'SELECT episode_id, other, "offset", votes FROM vt')
def diagonal_vote(spark, sf):
    return sequence.diagonal_vote(sequence.value_pairs(V.doc_frames(spark, sf), V.library_frames(spark, sf)), 20)


HITS = 'h AS (SELECT DISTINCT p.episode_id, p.frame FROM pr p JOIN vt v ON v.episode_id = p.episode_id AND v.other = p.other AND v."offset" = p.frame - p.other_frame)', "isl AS (" + ISLANDS.format(k="episode_id", p="frame", g=17, t="h") + ")", 'rg AS (SELECT episode_id, min(frame) AS "first", max(frame) AS "last", count(*) AS members FROM isl GROUP BY episode_id, run HAVING max(frame) - min(frame) + 1 >= {floor})'


@query(V.FRAMES, V.LIBFRAMES, *VOTES, *[h.format(floor=20) for h in HITS], 'SELECT episode_id, "first", "last", members FROM rg')
def match_regions(spark, sf):
    return sequence.match_regions(V.doc_frames(spark, sf), V.library_frames(spark, sf), None, 20, 20)


def _sizes(spark, sf, prints=None):
    prints = V.doc_fingerprints(spark, sf) if prints is None else prints
    f = prints.groupBy("episode_id").agg(F.sum(F.size("fingerprint")).alias("frames"))
    return f.withColumn("duration", F.col("frames") / 8)


@query(V.FRAMES, V.LIBFRAMES, *VOTES, *[h.format(floor=20) for h in HITS], """SELECT episode_id, "first" / 8.0::DOUBLE AS "start", ("last" + 1) / 8.0::DOUBLE AS "end", 'fpmatch' AS source FROM rg""")
def fp_detect(spark, sf):
    prints = stage(V.doc_fingerprints(spark, sf))
    regions = sequence.match_regions(sequence.frames(prints), V.library_frames(spark, sf), None, 20, 20)
    return sequence.spans_of_regions(regions, _sizes(spark, sf, prints))


SELF = "pr AS (SELECT q.episode_id, q.frame, l.episode_id AS other, l.frame AS other_frame FROM fr q JOIN fr l ON l.value = q.value AND l.episode_id <> q.episode_id WHERE q.value NOT IN (SELECT value FROM st))", 'vt AS (SELECT episode_id, other, frame - other_frame AS "offset", count(*) AS votes FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 40)'


@query(V.FRAMES, N, STOP.format(f=0.30), *SELF, *[h.format(floor=80) for h in HITS], 'SELECT episode_id, "first", "last", members FROM rg')
def discover_recurring(spark, sf):
    return sequence.discover_recurring(V.doc_frames(spark, sf))


def _campaigns(spark, sf):
    f = stage(V.doc_frames(spark, sf))
    runs, links = campaigns.run_links(f)
    return runs, links, sequence.match_regions(f, V.library_frames(spark, sf), None, 20, 20), T(spark, sf, "documents").count()


@query()  # tests on a small fixture: the pairs behind it are too many for SQL
def find_campaigns(spark, sf):
    return campaigns.campaign_summary(*_campaigns(spark, sf))


@query()
def select_seed_episodes(spark, sf):
    return campaigns.seed_episodes(*_campaigns(spark, sf))


@query("""e AS (SELECT o_custkey AS a, o_orderkey + 1000000000 AS b FROM orders UNION ALL SELECT l_partkey + 2000000000, l_orderkey + 1000000000 FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)""",
"""SELECT node, component FROM (WITH RECURSIVE r(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM u GROUP BY a
UNION SELECT u.b, min(r.component) FROM r JOIN u ON u.a = r.node JOIN recurring.r AS old ON old.node = u.b WHERE r.component < old.component GROUP BY u.b) SELECT node, component FROM r)""")
def connected_components(spark, sf):
    o, li = T(spark, sf, "orders"), T(spark, sf, "lineitem")
    e = o.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1000000000).alias("b"))
    return graph.components(e.unionByName(li.select((F.col("l_partkey") + 2000000000).alias("a"), (F.col("l_orderkey") + 1000000000).alias("b"))))


@query("s AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS owner FROM lineitem)", """c AS (WITH RECURSIVE r(step, item, owner) AS (SELECT 0, item, owner FROM s UNION ALL SELECT step + 1, item, owner FROM (
  SELECT step, item, owner, bool_or(owner = top) OVER (PARTITION BY item) AS gone FROM (SELECT *, first_value(owner) OVER (ORDER BY n DESC, owner) AS top FROM (SELECT *, count(*) OVER (PARTITION BY owner) AS n FROM r))) WHERE NOT gone)
  SELECT step, owner, count(*) AS n, row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, owner) AS k FROM r GROUP BY step, owner)""", "SELECT owner, n AS covers, CAST(step AS INT) AS rank FROM c WHERE k = 1")
def greedy_set_cover(spark, sf):
    return campaigns.greedy_set_cover(T(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("owner")))


# ------------------------------------------------------------------ whole tiers

SIZES = "sz AS (SELECT f.episode_id, f.frames, CAST(d.n_chars AS DOUBLE) / 16 AS duration FROM (SELECT episode_id, CAST(count(*) AS DOUBLE) AS frames FROM fr GROUP BY 1) f JOIN documents d ON d.doc_id = f.episode_id)"
KNOWN = "known AS (SELECT id, episode_id, \"start\", \"end\" FROM spans WHERE source IN ('chapter', 'llm', 'manual', 'dai'))"


def _complement(spans: str, timelines: str, out: str) -> str:
    """CTEs for what spans(episode_id, start, end) leave of timelines(episode_id, duration)."""
    return f"""{out}c AS (SELECT s.episode_id, greatest(0, least(s."start", t.duration)) AS "start", greatest(0, least(s."end", t.duration)) AS "end" FROM {spans} s JOIN {timelines} t ON t.episode_id = s.episode_id WHERE greatest(0, least(s."end", t.duration)) > greatest(0, least(s."start", t.duration))),
{out}k AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY episode_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {out}c),
{out}r AS (SELECT *, sum(n) OVER (PARTITION BY episode_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM {out}k),
{out}m AS (SELECT episode_id, min("start") AS "start", max("end") AS "end" FROM {out}r GROUP BY episode_id, run UNION ALL SELECT episode_id, -1, 0 FROM {timelines}),
{out}l AS (SELECT episode_id, "end" AS "start", lead("start") OVER (PARTITION BY episode_id ORDER BY "start") AS nxt FROM {out}m),
{out} AS (SELECT x.episode_id, x."start", coalesce(x.nxt, t.duration) AS "end" FROM {out}l x JOIN {timelines} t ON t.episode_id = x.episode_id WHERE coalesce(x.nxt, t.duration) > x."start")"""


EDITORIAL = "kz AS (SELECT * FROM sz WHERE episode_id IN (SELECT episode_id FROM known))", _complement("known", "kz", "gap"), """gp AS (SELECT episode_id, "start", least(60, "end" - "start") AS l FROM gap WHERE "end" - "start" >= 10),
gt AS (SELECT episode_id, "start", least(l, 180 - coalesce(sum(l) OVER (PARTITION BY episode_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM gp),
el AS (SELECT DISTINCT f.value FROM gt JOIN sz USING (episode_id) JOIN fr f ON f.episode_id = gt.episode_id AND f.frame BETWEEN ceil(gt."start" * (sz.frames / sz.duration)) AND floor((gt."start" + gt.t) * (sz.frames / sz.duration)) - 1 WHERE gt.t >= 10)"""
AUDIO = """al AS (SELECT k.id AS ad_id, k.episode_id, CAST(f.frame - ceil(k."start" * (sz.frames / sz.duration)) AS INT) AS frame, f.value FROM known k JOIN sz USING (episode_id) JOIN fr f ON f.episode_id = k.episode_id AND f.frame BETWEEN ceil(k."start" * (sz.frames / sz.duration)) AND floor(k."end" * (sz.frames / sz.duration)) - 1)""", """fq AS (SELECT value FROM al GROUP BY value HAVING count(DISTINCT episode_id) > 0.3 * (SELECT count(DISTINCT episode_id) FROM al)),
sp AS (SELECT value FROM fq WHERE value IN (SELECT value FROM el) OR NOT EXISTS (SELECT 1 FROM el))"""
TIER = V.FRAMES, V.SPANS, SIZES, KNOWN, *EDITORIAL


def _prints(spark, sf):
    """(episode_id, fingerprint) of documents with frames, written once, and their (episode_id, frames, duration) on the time of the spans."""
    prints = stage(V.doc_fingerprints(spark, sf))
    f = _sizes(spark, sf, prints).drop("duration")
    return prints, stage(f.join(T(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), (F.col("n_chars") / 16).alias("duration")), "episode_id"))


@query(*TIER, "SELECT value FROM el")
def editorial_stoplist(spark, sf):
    return tiers.editorial_stoplist(*_prints(spark, sf), V.spans(spark, sf))


@query(*TIER, *AUDIO, "SELECT ad_id, episode_id, frame, value, value IN (SELECT value FROM sp) AS stopped FROM al")
def audio_library(spark, sf):
    library, stop = tiers.audio_library(*_prints(spark, sf), V.spans(spark, sf))
    return library.join(F.broadcast(stop.withColumn("_s", F.lit(True))), "value", "left").select("ad_id", "episode_id", "frame", "value", F.col("_s").isNotNull().alias("stopped"))


@query(*once(*TIER, *AUDIO, V.EPISODES, V.SEG, SPOKEN, "lk AS (SELECT sz.* FROM sz WHERE episode_id IN (SELECT id FROM episodes WHERE audio_url IS NOT NULL) AND EXISTS (SELECT 1 FROM al))",
"pr AS (SELECT q.episode_id, q.frame, l.ad_id AS other, l.frame AS other_frame FROM fr q JOIN al l ON l.value = q.value AND l.episode_id <> q.episode_id WHERE q.episode_id IN (SELECT episode_id FROM lk) AND q.value NOT IN (SELECT value FROM sp))", VOTES[1], *[h.format(floor=20) for h in HITS],
"""fd AS (SELECT rg.episode_id, rg."first" * sz.duration / sz.frames AS "start", (rg."last" + 1) * sz.duration / sz.frames AS "end" FROM rg JOIN sz USING (episode_id)),
sk AS (SELECT fd.episode_id, fd."start", fd."end" FROM fd LEFT JOIN w ON w.episode_id = fd.episode_id AND w."end" > fd."start" AND w."start" < fd."end" GROUP BY ALL HAVING coalesce(sum(w.n), 0) >= 5 OR fd.episode_id NOT IN (SELECT episode_id FROM w))"""),
"""SELECT id, episode_id, "start", "end", source FROM spans WHERE source <> 'fpmatch' OR episode_id NOT IN (SELECT episode_id FROM lk) UNION ALL SELECT NULL, episode_id, "start", "end", 'fpmatch' FROM sk""")
def apply_fingerprints(spark, sf):
    return tiers.apply_fingerprints(V.episodes(spark, sf), V.spans(spark, sf), *_prints(spark, sf), V.segments(spark, sf), 20, 20)


REPEAT_LIB = """lib AS (SELECT DISTINCT g.shingle FROM grams g JOIN seg s USING (episode_id, seg_idx) WHERE EXISTS (SELECT 1 FROM spans x WHERE x.episode_id = s.episode_id AND x.source IN ('chapter', 'llm', 'manual') AND s."end" > x."start" AND s."start" < x."end"))"""
REPEAT_LK = "lk AS (SELECT id FROM episodes WHERE transcript_path IS NOT NULL AND EXISTS (SELECT 1 FROM lib))"


@query(*once(V.SEG, V.SPANS, V.EPISODES, V.SEGW, V.GRAMS, REPEAT_LIB, V.RATIO, *RUNS,
REPEAT_LK), """SELECT id, episode_id, "start", "end", source FROM spans WHERE source <> 'repeat' OR episode_id NOT IN (SELECT id FROM lk)
UNION ALL SELECT NULL, r.episode_id, a."start", b."end", 'repeat' FROM runs r JOIN lk ON lk.id = r.episode_id JOIN seg a ON a.episode_id = r.episode_id AND a.seg_idx = r."first" JOIN seg b ON b.episode_id = r.episode_id AND b.seg_idx = r."last" """)
def apply_repeats(spark, sf):
    return tiers.apply_repeats(V.episodes(spark, sf), V.spans(spark, sf), V.segments(spark, sf))


@contextmanager
def _folder(spark):
    """A folder of the shared one, gone at the end; what is returned from it is staged."""
    name = f"t{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    yield name, path
    drop_path(spark, path)


@query(*once(V.SEG, V.SPANS, V.EPISODES, V.SEGW, V.GRAMS, REPEAT_LIB, V.RATIO, *RUNS, REPEAT_LK), """SELECT episode_id, "start", "end", source FROM spans WHERE source <> 'repeat' OR episode_id NOT IN (SELECT id FROM lk)
UNION ALL SELECT r.episode_id, a."start", b."end", 'repeat' FROM runs r JOIN lk ON lk.id = r.episode_id JOIN seg a ON a.episode_id = r.episode_id AND a.seg_idx = r."first" JOIN seg b ON b.episode_id = r.episode_id AND b.seg_idx = r."last" """)
def stored_repeats(spark, sf):
    """The repeat tier over real tables, twice: the second sweep finds what the first wrote, and changes nothing."""
    with _folder(spark) as (_, path):
        store, segments = st.open_store(spark, path), stage(V.segments(spark, sf))
        store.replace("episodes", V.episodes(spark, sf))
        store.replace("ad_segments", V.spans(spark, sf).withColumnsRenamed({"start": "start_second", "end": "end_second"}))
        for _ in range(2):
            st.sweep_repeats(store, segments)
        return stage(st.spans_of(store).select("episode_id", "start", "end", "source"))


ALL_REGIONS = (*once(*TIER, *AUDIO, "pr AS (SELECT q.episode_id, q.frame, l.ad_id AS other, l.frame AS other_frame FROM fr q JOIN al l ON l.value = q.value AND l.episode_id <> q.episode_id WHERE q.value NOT IN (SELECT value FROM sp))", VOTES[1], *[h.format(floor=20) for h in HITS]), 'SELECT episode_id, "first", "last", members FROM rg')


@query(*ALL_REGIONS)
def indexed_regions(spark, sf):
    """All episodes against a persisted index of the confirmed spans."""
    (prints, sizes), spans = _prints(spark, sf), V.spans(spark, sf)
    library = tiers.library_frames(prints, sizes, spans)
    with _folder(spark) as (name, path):
        inverted.write_index(library, stage(tiers.editorial_stoplist(prints, sizes, spans)), name, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = stage(inverted.indexed_regions(sequence.frames(prints), name, path, match_frames=20, floor=20))
        inverted.drop_index(spark, name, path)
        return out


@query(*ALL_REGIONS)
def delta_regions(spark, sf):
    """The same regions, from fingerprints that come in files, a micro-batch each."""
    (prints, sizes), spans = _prints(spark, sf), stage(V.spans(spark, sf))
    _, stop = tiers.audio_library(prints, sizes, spans)
    with _folder(spark) as (name, path):
        prints.join(sizes, "episode_id").select("episode_id", "fingerprint", "duration").repartition(3).write.parquet(f"{path}/in")
        index = delta.DeltaIndex(spark, f"{path}/state", name, stage(stop), int(spark.conf.get("spark.sql.shuffle.partitions")), 20, 20)
        delta.match_incrementally(index, f"{path}/in", "episode_id LONG, fingerprint ARRAY<LONG>, duration DOUBLE", lambda: spans, f"{path}/checkpoint", 1)
        out = stage(index.regions())
        index.drop()
        return out


OTHERS = """ts AS (SELECT episode_id, seg_idx FROM seg s WHERE EXISTS (SELECT 1 FROM spans x WHERE x.episode_id = s.episode_id AND x.source IN ('chapter', 'llm', 'manual') AND s."end" > x."start" AND s."start" < x."end")),
ow AS (SELECT g.shingle, count(DISTINCT g.episode_id) AS owners, min(g.episode_id) AS owner FROM grams g JOIN ts USING (episode_id, seg_idx) GROUP BY 1),
ratio AS (SELECT g.episode_id, g.seg_idx, CAST(count(CASE WHEN o.owners > 1 OR o.owner <> g.episode_id THEN 1 END) AS DOUBLE) / count(*) AS ratio FROM grams g LEFT JOIN ow o ON o.shingle = g.shingle GROUP BY 1, 2)"""


@query(*once(V.SEG, V.SPANS, V.SEGW, V.GRAMS, OTHERS, *RUNS), """SELECT episode_id, count(*) AS truth, count(r) AS found, CAST(count(r) AS DOUBLE) / count(*) AS recall
FROM (SELECT ts.episode_id, ts.seg_idx, max(runs."first") AS r FROM ts LEFT JOIN runs ON runs.episode_id = ts.episode_id AND ts.seg_idx BETWEEN runs."first" AND runs."last" GROUP BY 1, 2) GROUP BY 1""")
def text_recall(spark, sf):
    return text.text_recall(V.segments(spark, sf), V.spans(spark, sf))


@query(*once(*TIER, AUDIO[0], """ao AS (SELECT DISTINCT value, episode_id FROM al), ne AS (SELECT count(DISTINCT episode_id) AS n FROM ao), vc AS (SELECT value, count(*) AS c FROM ao GROUP BY value)""",
"""fs AS (SELECT fr.episode_id, fr.frame, fr.value FROM fr LEFT JOIN vc ON vc.value = fr.value LEFT JOIN ao ON ao.value = fr.value AND ao.episode_id = fr.episode_id
  WHERE NOT coalesce(vc.c - (ao.value IS NOT NULL)::INT > 0.3 * ((SELECT n FROM ne) - (fr.episode_id IN (SELECT episode_id FROM ao))::INT) AND (fr.value IN (SELECT value FROM el) OR NOT EXISTS (SELECT 1 FROM el)), false))""",
"pr AS (SELECT q.episode_id, q.frame, l.ad_id AS other, l.frame AS other_frame FROM fs q JOIN al l ON l.value = q.value AND l.episode_id <> q.episode_id)", VOTES[1], *[h.format(floor=20) for h in HITS],
"""ad AS (SELECT k.id, k.episode_id, ceil(k."start" * (sz.frames / sz.duration)) AS f, floor(k."end" * (sz.frames / sz.duration)) - 1 AS l FROM known k JOIN sz USING (episode_id)),
mt AS (SELECT ad.id, ad.episode_id, ad.l - ad.f + 1 AS size, coalesce(sum(CASE WHEN rg."first" IS NOT NULL THEN greatest(0, least(ad.l, rg."last") - greatest(ad.f, rg."first") + 1) END), 0) AS met FROM ad LEFT JOIN rg ON rg.episode_id = ad.episode_id WHERE ad.l >= ad.f GROUP BY 1, 2, 3)"""),
"SELECT episode_id, count(*) AS ads, count_if(met > 0) AS found, CAST(sum(size) AS BIGINT) AS ad_frames, CAST(sum(met) AS BIGINT) AS found_frames FROM mt GROUP BY 1")
def audio_recall(spark, sf):
    return tiers.audio_recall(*_prints(spark, sf), V.spans(spark, sf), 20, 20)


@query(V.EPISODES, V.SPANS, SNAPPED, "tm AS (SELECT id AS episode_id, duration FROM episodes)", _complement("sn", "tm", "kp"),
'SELECT tm.episode_id, tm.duration, tm.duration - coalesce(sum(kp."end" - kp."start"), 0) AS ad_seconds, coalesce(tm.duration > 0 AND (tm.duration - coalesce(sum(kp."end" - kp."start"), 0)) / tm.duration > 0.35, false) AS anomalous FROM tm LEFT JOIN kp ON kp.episode_id = tm.episode_id GROUP BY 1, 2')
def cut_plan_snapped(spark, sf):
    s, timelines = V.spans(spark, sf), V.episodes(spark, sf).select(F.col("id").alias("episode_id"), "duration")
    return tiers.cut_plan(timelines, s, s.where("source = 'recur'").select("episode_id", "start", "end"))[1]


# ------------------------------------------------------------------ queues and tables

EP = (V.EPISODES,)


def _pending(name, where_sql, build, *views):
    def f(spark, sf):
        return build(V.episodes(spark, sf), V.spans(spark, sf)).select("id", "feed_id")

    f.__name__ = name
    query(*EP, *views, f"SELECT id, feed_id FROM episodes WHERE {where_sql}")(f)


_pending("pending_chapters", "chapters_url IS NOT NULL AND chapters_scanned_at IS NULL", lambda e, s: queues.pending_chapters(e))
_pending("pending_transcribe", "transcript_path IS NULL AND audio_url IS NOT NULL AND audio_gone_at IS NULL AND id NOT IN (SELECT episode_id FROM spans WHERE source = 'chapter') ORDER BY id LIMIT 40", lambda e, s: queues.pending_transcribe(e, s, 40), V.SPANS)
_pending("pending_detect", "transcript_path IS NOT NULL AND llm_detected_at IS NULL", lambda e, s: queues.pending_detect(e, 0))
_pending("pending_cut", "cut_path IS NULL AND cut_held_at IS NULL AND id IN (SELECT episode_id FROM spans WHERE source IN ('chapter', 'llm', 'manual', 'repeat', 'fpmatch'))", lambda e, s: queues.pending_cut(e, s), V.SPANS)
_pending("pending_index", "audio_url IS NOT NULL AND id NOT IN (SELECT episode_id FROM spans WHERE source = 'dai') AND id % 2 = 0", lambda e, s: queues.pending_index(e, s.where("source = 'dai'"), F.col("audio_url").isNotNull(), e.where("id % 2 = 0").select("id")), V.SPANS)
_pending("pending_stream_index", "audio_url IS NOT NULL AND audio_gone_at IS NULL AND id NOT IN (SELECT episode_id FROM spans WHERE source = 'fpmatch')", lambda e, s: queues.pending_index(e, s.where("source = 'fpmatch'"), F.expr("audio_url is not null and audio_gone_at is null")), V.SPANS)


@query(V.EPISODES, "SELECT id, CASE WHEN id % 4 = 0 THEN '2026-02-01T00:00:00Z' ELSE audio_gone_at END AS audio_gone_at FROM episodes")
def mark_audio_gone(spark, sf):
    return queues.stamped(V.episodes(spark, sf), S.is_audio_gone(F.when(F.col("id") % 4 == 0, 404).otherwise(403)), audio_gone_at=F.lit("2026-02-01T00:00:00Z")).select("id", "audio_gone_at")


@query(V.EPISODES, "SELECT id, CASE WHEN id % 26 = 0 THEN NULL ELSE cut_path END AS cut_path, CASE WHEN id % 26 = 0 THEN '2026-02-01T00:00:00Z' ELSE cut_held_at END AS cut_held_at FROM episodes")
def hold_cut(spark, sf):
    return queues.hold_cut(V.episodes(spark, sf), F.col("id") % 26 == 0, F.lit("2026-02-01T00:00:00Z")).select("id", "cut_path", "cut_held_at")


@query(V.FEEDS, V.EPISODES, V.SPANS, """SELECT 'feeds' AS what, count(*) AS n FROM feeds UNION ALL SELECT 'episodes', count(*) FROM episodes UNION ALL SELECT 'transcribed', count(transcript_path) FROM episodes UNION ALL SELECT 'cut', count(cut_path) FROM episodes UNION ALL SELECT 'source ' || source, count(*) FROM spans GROUP BY source""")
def stats(spark, sf):
    return queues.stats(V.feeds(spark, sf), V.episodes(spark, sf), V.spans(spark, sf))


COUNTS = "tc AS (SELECT e.id, e.feed_id, count(s.episode_id) AS n FROM episodes e LEFT JOIN spans s ON s.episode_id = e.id AND s.source IN ('chapter', 'llm', 'manual') WHERE e.llm_detected_at IS NOT NULL GROUP BY 1, 2)"
MEDIANS = "md AS (SELECT feed_id, median(n) AS median, count(*) AS episodes FROM tc GROUP BY feed_id HAVING count(*) >= 3)"


@query(V.EPISODES, V.SPANS, COUNTS, "SELECT id, feed_id, n FROM tc")
def truth_counts(spark, sf):
    return queues.truth_counts(V.episodes(spark, sf), V.spans(spark, sf))


@query(V.EPISODES, V.SPANS, COUNTS, MEDIANS, "SELECT feed_id, median, episodes FROM md")
def median_per_show(spark, sf):
    return queues.median_per_show(queues.truth_counts(V.episodes(spark, sf), V.spans(spark, sf)))


@query(V.EPISODES, V.SPANS, COUNTS, MEDIANS, "f AS (SELECT episode_id AS id, count(*) AS n FROM spans WHERE source = 'repeat' GROUP BY 1)",
"SELECT p.id, p.feed_id, abs(coalesce(f.n, 0) - md.median) AS diff, CAST(row_number() OVER (ORDER BY md.median IS NULL, abs(coalesce(f.n, 0) - md.median) DESC NULLS LAST, p.id) AS INT) AS place FROM episodes p LEFT JOIN f ON f.id = p.id LEFT JOIN md ON md.feed_id = p.feed_id WHERE p.transcript_path IS NOT NULL AND p.llm_detected_at IS NULL")
def prioritize_queue(spark, sf):
    e, s = V.episodes(spark, sf), V.spans(spark, sf)
    found = s.where("source = 'repeat'").groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("n"))
    return queues.prioritize(queues.pending_detect(e), found, queues.median_per_show(queues.truth_counts(e, s)))


@query(V.SPANS, "x AS (SELECT DISTINCT episode_id FROM spans WHERE source = 'repeat' AND episode_id % 2 = 0)", """SELECT id, episode_id, "start", "end", source FROM spans WHERE NOT (source = 'fpmatch' AND episode_id IN (SELECT episode_id FROM x)) UNION ALL SELECT id, episode_id, "start", "end", 'fpmatch' FROM spans WHERE source = 'repeat' AND episode_id % 2 = 0""")
def replace_tier_spans(spark, sf):
    s = V.spans(spark, sf)
    return queues.replace_tier(s, s.where("source = 'repeat' and episode_id % 2 = 0").drop("source"), "fpmatch")


@query(V.FEEDS, "u AS (SELECT DISTINCT 'https://f/' || (s_suppkey % 40) AS source_url FROM supplier WHERE 'https://f/' || (s_suppkey % 40) NOT IN (SELECT source_url FROM feeds))", "SELECT id, source_url FROM feeds UNION ALL SELECT (SELECT max(id) FROM feeds) + row_number() OVER (ORDER BY source_url), source_url FROM u")
def feed_register(spark, sf):
    urls = T(spark, sf, "supplier").select(F.concat(F.lit("https://f/"), (F.col("s_suppkey") % 40).cast("string")).alias("source_url"))
    return queues.register(V.feeds(spark, sf), urls).select("id", "source_url")


@query(V.FEEDS, "SELECT id, CASE WHEN id % 2 = 0 THEN 'R' || id ELSE title END AS title FROM feeds")
def feed_refresh(spark, sf):
    f = V.feeds(spark, sf)
    new = f.select("source_url", F.when(F.col("id") % 2 == 0, F.concat(F.lit("R"), F.col("id").cast("string"))).alias("title"))
    return queues.refresh(f, new, ("title",)).select("id", "title")


@query("inc AS (SELECT * FROM (SELECT o_custkey AS k, o_orderstatus AS s, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)",
"SELECT coalesce(c.c_custkey, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.s ELSE c.s END AS s, CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN i.k IS NOT NULL AND i.s IS DISTINCT FROM c.s THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'O' ELSE 'F' END AS s FROM customer WHERE c_custkey % 4 <> 0) c FULL JOIN inc i ON i.k = c.c_custkey")
def episode_upsert(spark, sf):
    k = F.col("c_custkey")
    old = T(spark, sf, "customer").where(k % 4 != 0).select(k.alias("k"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "O").otherwise("F").alias("s"))
    new = T(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("pos"))
    return queues.upsert(old, new, ["k"], ("s",), "pos")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_first(spark, sf):
    return queues.dedupe_first(T(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query(V.EPISODES, "SELECT id, pubdate, CAST(row_number() OVER (ORDER BY pubdate DESC NULLS LAST, id) AS INT) AS place FROM episodes WHERE feed_id = 3")
def feed_episodes(spark, sf):
    return queues.feed_episodes(V.episodes(spark, sf), 3).select("id", "pubdate", "place")


# ------------------------------------------------------------------ sources, sinks, scalars


@query("d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 3) || ':' || (event_id % 59) || ':' || (event_id % 57) WHEN 1 THEN (event_id % 90) || ':' || (event_id % 60) WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN 'bogus' WHEN 4 THEN (event_id % 77) || '.75' END AS raw FROM events)",
"SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN event_id % 3 * 3600 + event_id % 59 * 60 + event_id % 57 WHEN 1 THEN event_id % 90 * 60 + event_id % 60 WHEN 2 THEN event_id WHEN 4 THEN event_id % 77 END AS INT) AS seconds FROM d")
def parse_duration(spark, sf):
    e = F.col("event_id")
    s = lambda m: (e % m).cast("string")
    raw = F.when(e % 6 == 0, F.concat_ws(":", s(3), s(59), s(57))).when(e % 6 == 1, F.concat_ws(":", s(90), s(60))).when(e % 6 == 2, e.cast("string")).when(e % 6 == 3, "bogus").when(e % 6 == 4, F.concat(s(77), F.lit(".75")))
    return T(spark, sf, "events").select("event_id", S.parse_duration(raw).alias("seconds"))


@query("SELECT p_partkey, regexp_matches(p_type, '(?i)\\b(ad|ads|advert|advertisement|sponsor|sponsors|sponsored|promo)\\b') AS hit FROM part")
def keyword_match(spark, sf):
    return T(spark, sf, "part").select("p_partkey", S.keyword_match(F.col("p_type")).alias("hit"))


@query("SELECT o_orderkey, CAST((o_orderkey + 4294967000) & 4294967295 AS BIGINT) + o_custkey AS total, CAST(2 AS BIGINT) AS frames FROM orders")
def parse_fingerprint(spark, sf):
    raw = F.concat((F.col("o_orderkey") + 4294967000).cast("string"), F.lit(",,"), F.col("o_custkey").cast("string"), F.lit(","))
    fp = S.parse_fingerprint(raw)
    return T(spark, sf, "orders").select("o_orderkey", F.aggregate(fp, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(fp).cast("long").alias("frames"))


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return T(spark, sf, "events").select("user_id", "event_id", F.from_json("props", "k LONG")["k"].alias("k"))


@query('c AS (SELECT event_id % 500 AS episode_id, event_id, CAST(event_id % 4000 AS DOUBLE) / 4 AS s, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 4000 + 40 AS DOUBLE) / 4 END AS e, event_type || CASE WHEN event_id % 3 = 0 THEN \' Sponsor break\' ELSE \' talk\' END AS title FROM events)',
"x AS (SELECT *, lead(s) OVER (PARTITION BY episode_id ORDER BY event_id) AS nxt FROM c)", V.EPISODES, """SELECT x.episode_id, x.s AS "start", coalesce(x.e, x.nxt, p.duration) AS "end", 'chapter' AS source, x.title AS reason FROM x LEFT JOIN episodes p ON p.id = x.episode_id WHERE coalesce(x.e, x.nxt, p.duration) IS NOT NULL AND regexp_matches(x.title, '(?i)\\b(ad|ads|advert|advertisement|sponsor|sponsors|sponsored|promo)\\b')""")
def chapters_tier(spark, sf):
    e = F.col("event_id")
    one = F.struct(e.alias("_o"), (e % 4000 / 4).alias("startTime"), F.concat(F.col("event_type"), F.when(e % 3 == 0, " Sponsor break").otherwise(" talk")).alias("title"), F.when(e % 5 == 0, (e % 4000 + 40) / 4).alias("endTime"))
    raw = T(spark, sf, "events").groupBy((e % 500).alias("episode_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("chapters"))).alias("json"))
    return chapters.chapters_tier(fs.chapters_of(raw, "episode_id", "json"), V.episodes(spark, sf).withColumnRenamed("duration", "duration_seconds"))


@query("SELECT conv_id AS episode_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS seg_idx, CAST(turn AS DOUBLE) AS \"start\", CAST(turn + 1 AS DOUBLE) AS \"end\", text FROM conversations")
def scan_transcript(spark, sf):
    one = F.struct("turn", "role", F.col("text").alias("_t"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")
    arr = F.array_sort(F.collect_list(one))
    raw = T(spark, sf, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(arr.alias("a"))
    js = F.when(F.col("episode_id") % 2 == 0, F.to_json("a")).otherwise(F.to_json(F.struct(F.col("a").alias("segments"))))
    return fs.transcript_of(raw.select("episode_id", js.alias("j")), "episode_id", F.col("j"))


@query("SELECT user_id, CAST(event_id AS DOUBLE) / 4 AS \"start\", CAST(event_id + 3 AS DOUBLE) / 4 AS \"end\" FROM events WHERE event_id % 4 <> 0")
def silence_scan(spark, sf):
    e = F.col("event_id")
    text_ = F.when(F.col("half") == 0, F.concat(F.lit("[x] silence_start: "), (e / 4).cast("string"))).otherwise(F.concat(F.lit("[x] silence_end: "), ((e + 3) / 4).cast("string"), F.lit(" | silence_duration: 0.75")))
    lines = T(spark, sf, "events").select("user_id", "event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).where((e % 4 != 0) | (F.col("half") == 0)).select("user_id", (e * 2 + F.col("half")).alias("pos"), text_.alias("line"))
    return fs.silences_of(lines, ["user_id"], "pos", "line")


@query("SELECT page_id, url || '.mp3' AS audio_url, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/h' END AS chapters_url FROM pages")
def rss_enclosure(spark, sf):
    enc = lambda u, t: F.struct(u.alias("_url"), F.lit(t).alias("_type"))
    u = F.col("url")
    ch = F.struct(F.when(F.col("page_id") % 2 == 0, u).otherwise(F.lit("")).alias("_url"), F.concat(u, F.lit("/h")).alias("_href"))
    return T(spark, sf, "pages").select("page_id", fs.audio_url(F.array(enc(u, "text/html"), enc(F.lit(""), "audio/ogg"), enc(F.concat(u, F.lit(".mp3")), "audio/mpeg"))).alias("audio_url"), fs.chapters_url(ch).alias("chapters_url"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS pubdate FROM orders")
def rss_pubdate(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", fs.pubdate(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss Z")).alias("pubdate"))


CUTS = "ct AS (SELECT doc_id AS id, '/cuts/x.y/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.m4a' ELSE '.mp3' END AS cut_path, n_chars AS length, left(text, 20) AS description FROM documents)"


def _published(spark, sf):
    """Episodes with a description and the paths of their cut files, and the sizes of two thirds of the files."""
    i = F.col("doc_id")
    made = T(spark, sf, "documents").select(i.alias("id"), F.concat(F.lit("/cuts/x.y/"), i.cast("string"), F.when(i % 2 == 0, ".m4a").otherwise(".mp3")).alias("_path"), F.col("n_chars").alias("length"), F.left("text", F.lit(20)).alias("description"))
    e = V.episodes(spark, sf).join(made, "id").withColumn("cut_path", F.when(F.col("cut_path").isNotNull(), F.col("_path")))
    return e.drop("_path", "length"), made.where("id % 3 <> 0").select(F.col("_path").alias("cut_path"), "length")


@query(V.EPISODES, CUTS, """x AS (SELECT e.*, ct.description, CASE WHEN e.cut_path IS NOT NULL THEN 'http://h/audio/' || e.id || right(ct.cut_path, 4) ELSE e.audio_url END AS url, CASE WHEN e.cut_path IS NOT NULL AND e.id % 3 <> 0 THEN ct.length ELSE 0 END AS length FROM episodes e JOIN ct ON ct.id = e.id)""",
"""SELECT feed_id, id, pubdate, '<item><title>' || CASE WHEN title IS NULL THEN '(untitled)' ELSE replace(title, '&', '&amp;') END || '</title><description>' || replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</description><guid isPermaLink="false">' || guid
|| '</guid><enclosure url="' || url || '" length="' || length || '" type="audio/mpeg"/>' || CASE WHEN pubdate IS NULL THEN '' ELSE '<pubDate>' || strftime(strptime(pubdate, '%Y-%m-%dT%H:%M:%SZ'), '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate>' END || '</item>' AS xml FROM x WHERE url IS NOT NULL""")
def emit_rss(spark, sf):
    e, cuts = _published(spark, sf)
    return fs.rss_items(e, "http://h", cuts)


@query(V.EPISODES, """i AS (SELECT *, coalesce(CASE WHEN cut_path IS NOT NULL THEN 'http://h/audio/' || id || '.m' END, audio_url) AS url FROM episodes), n AS (SELECT * FROM i WHERE url IS NOT NULL)""",
"""SELECT feed_id, count(*) AS total, count_if(id % 2 = 1) AS inserted, count_if(id % 2 = 0 AND (id % 4 = 0 OR title IS NULL OR cut_path IS NOT NULL)) AS updated, CAST(NULL AS VARCHAR) AS error FROM n GROUP BY feed_id""")
def ingest_all(spark, sf):
    """Feeds written as files and taken in again, where every second episode is known, and some known ones differ."""
    e = V.episodes(spark, sf).withColumns({"description": F.lit(None).cast("string"), "cut_path": F.when(F.col("cut_path").isNotNull(), "c.m")})
    known = e.where("id % 2 = 0").select("id", "feed_id", "guid", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("title")).alias("title"), F.lit("").alias("description"), "pubdate", F.lit(None).cast("int").alias("duration_seconds"), "audio_url", F.lit(None).cast("string").alias("chapters_url"), "chapters_scanned_at")
    feeds = e.select(F.col("feed_id").alias("id")).distinct().withColumn("source_url", F.concat(F.lit("f"), F.col("id").cast("string"))).withColumns({c: F.lit(None).cast("string") for c in ("title", "description", "image_url", "last_fetched_at")})
    with _folder(spark) as (_, path):
        fs.rss(feeds, e, "http://h").select(F.concat(F.lit("f"), F.col("feed_id").cast("string")).alias("feed"), F.col("xml").alias("value")).repartition("feed").write.partitionBy("feed").text(path)
        scanned = fs.scan_feeds(spark, f"{path}/feed=*").withColumn("source_url", F.regexp_extract("file", "/feed=([^/]*)/", 1))
        return stage(fs.ingest_all(feeds, known, scanned, F.lit("2026-01-01T00:00:00Z"))[2].drop("source_url").where("total > 0"))


# ------------------------------------------------------------------ bytes and model chunks


PARTING = "p AS (SELECT a.doc_id AS episode_id, hex(encode(a.text)) AS x, hex(encode(b.text)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)", """dv AS (WITH RECURSIVE r(episode_id, lo, hi) AS (SELECT episode_id, CAST(0 AS BIGINT), CAST(least(length(x), length(y)) // 2 AS BIGINT) FROM p
  UNION ALL SELECT q.episode_id, CASE WHEN q.same THEN q.mid ELSE q.lo END, CASE WHEN q.same THEN q.hi ELSE q.mid - 1 END FROM (SELECT r.episode_id, r.lo, r.hi, (r.lo + r.hi + 1) // 2 AS mid, left(p.x, 2 * ((r.lo + r.hi + 1) // 2)) = left(p.y, 2 * ((r.lo + r.hi + 1) // 2)) AS same FROM r JOIN p ON p.episode_id = r.episode_id WHERE r.lo < r.hi) q)
  SELECT r.episode_id, CASE WHEN r.lo < least(length(p.x), length(p.y)) // 2 THEN r.lo END AS d, p.x, p.y FROM r JOIN p ON p.episode_id = r.episode_id WHERE r.lo = r.hi)"""


@query(*PARTING, "SELECT episode_id, d AS divergence_byte FROM dv")
def first_divergence(spark, sf):
    return V.text_pairs(spark, sf).select("episode_id", bytesdiff.first_divergence("a", "b").alias("divergence_byte"))


@query(*PARTING, """an AS (SELECT *, length(x) // 2 AS size, CASE WHEN length(substr(x, 2 * (d + 64) + 1, 32)) = 32 THEN regexp_replace(substr(x, 2 * (d + 64) + 1, 32), '(..)', '\\1 ', 'g') END AS anchor FROM dv),
mt AS (SELECT *, strpos(regexp_replace(y, '(..)', '\\1 ', 'g'), anchor) AS place FROM an), rc AS (SELECT episode_id, size, d, CASE WHEN place > 0 THEN (place - 1) // 3 END AS r, size / 16 AS duration FROM mt),
sc AS (SELECT *, d / 16 + 2 AS s, least(r / 16 - 2, d / 16 + 2 + 240, duration) AS e FROM rc), rj AS (SELECT *, CASE WHEN d IS NULL THEN 'no divergence' WHEN r IS NULL THEN 'no realignment' WHEN duration <= 0 THEN 'unreadable' WHEN e - s < 8 THEN 'too short' END AS reject FROM sc)""",
'SELECT episode_id, CASE WHEN reject IS NULL THEN s END AS "start", CASE WHEN reject IS NULL THEN e END AS "end", CASE WHEN reject IS NULL THEN 0.5::DOUBLE END AS confidence, reject FROM rj')
def dai_tier(spark, sf):
    pairs = V.text_pairs(spark, sf)
    probe = bytesdiff.probe_variance(pairs, skip=64, size=16)
    return bytesdiff.dai_spans(probe, pairs.select("episode_id", F.octet_length("a").alias("size"), (F.octet_length("a") / 16).alias("duration")))


@query("p AS (SELECT event_id AS episode_id, event_id * 7919 % 900000 AS d, event_id * 7919 % 900000 + event_id * 101 % 400000 AS r FROM events WHERE event_id % 5 <> 0)",
"s AS (SELECT episode_id, d / 1000.0::DOUBLE + 2 AS s, least(r / 1000.0::DOUBLE - 2, d / 1000.0::DOUBLE + 2 + 240, 1000) AS e FROM p)", "SELECT episode_id, CASE WHEN e - s >= 8 THEN s END AS \"start\", CASE WHEN e - s >= 8 THEN e END AS \"end\", CASE WHEN e - s >= 8 THEN 0.5::DOUBLE END AS confidence, CASE WHEN e - s < 8 THEN 'too short' END AS reject FROM s UNION ALL SELECT event_id, NULL, NULL, NULL, 'no divergence' FROM events WHERE event_id % 5 = 0")
def bytes_to_seconds(spark, sf):
    e = F.col("event_id")
    p = T(spark, sf, "events").select(e.alias("episode_id"), F.when(e % 5 != 0, e * 7919 % 900000).alias("divergence_byte"), F.when(e % 5 != 0, e * 7919 % 900000 + e * 101 % 400000).alias("reconvergence_byte"))
    return bytesdiff.dai_spans(p, p.select("episode_id", F.lit(1000000).alias("size"), F.lit(1000.0).alias("duration")))


@query(V.SEG, V.SPANS, """sg AS (SELECT s.*, EXISTS (SELECT 1 FROM spans x WHERE x.episode_id = s.episode_id AND s."end" > x."start" AND s."start" < x."end") AS skip FROM seg s),
gr AS (SELECT *, sum(CASE WHEN skip THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY seg_idx) AS run FROM sg),
ln AS (SELECT episode_id, seg_idx * 2 + 1 AS pos, format('[{}] {:.1f}-{:.1f}: {}', seg_idx, "start", "end", text) AS line FROM gr WHERE NOT skip UNION ALL SELECT episode_id, max(seg_idx) * 2, format('({} segment(s) already known)', count(*)) FROM gr WHERE skip GROUP BY episode_id, run),
nl AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS n FROM ln),
ck AS (WITH RECURSIVE r(episode_id, n, chunk, size) AS (SELECT episode_id, n, 0, length(line) + 1 FROM nl WHERE n = 1 UNION ALL SELECT l.episode_id, l.n, CASE WHEN r.size + length(l.line) + 1 > 2000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(l.line) + 1 > 2000 THEN 0 ELSE r.size END + length(l.line) + 1 FROM r JOIN nl l ON l.episode_id = r.episode_id AND l.n = r.n + 1) SELECT * FROM r)""",
"SELECT ck.episode_id, CAST(ck.chunk AS INT) AS chunk, CAST(count(*) AS INT) AS lines, string_agg(nl.line, chr(10) ORDER BY nl.n) AS text FROM ck JOIN nl ON nl.episode_id = ck.episode_id AND nl.n = ck.n GROUP BY 1, 2")
def greedy_chunks(spark, sf):
    seg = V.segments(spark, sf)
    return detect.chunks(seg, intervals.covered_segments(seg, V.spans(spark, sf)), 2000)


@query(V.SEG, """lc AS (SELECT episode_id, count(*) AS n FROM seg GROUP BY 1), a AS (SELECT lc.episode_id, v.event_id * 31 % lc.n AS f, v.event_id * 31 % lc.n + v.event_id % 13 - 2 AS l, v.event_type FROM events v JOIN lc ON lc.episode_id = v.event_id % (SELECT count(*) FROM documents))""", """SELECT a.episode_id, s."start", e."end", 'llm' AS source, a.event_type AS reason FROM a JOIN seg s ON s.episode_id = a.episode_id AND s.seg_idx = a.f JOIN seg e ON e.episode_id = a.episode_id AND e.seg_idx = a.l WHERE a.f <= a.l""")
def span_grounding(spark, sf):
    """Answers on lines anywhere in a document; the last index can lie before the first or beyond the end."""
    e, seg = F.col("event_id"), V.segments(spark, sf)
    many = F.broadcast(T(spark, sf, "documents").agg(F.count("*").alias("_many")))  # one row
    a = T(spark, sf, "events").join(many).withColumn("episode_id", e % F.col("_many")).join(seg.groupBy("episode_id").agg(F.count("*").alias("_n")), "episode_id")
    first = e * 31 % F.col("_n")
    a = a.select("episode_id", first.cast("int").alias("first"), (first + e % 13 - 2).cast("int").alias("last"), F.concat(F.lit(" "), F.col("event_type")).alias("reason"))
    return detect.grounded(a, seg)
