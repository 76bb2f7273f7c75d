"""Queries over text, labels and vectors: functions, lexicon look-ups, parsing, checks and splits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators import checks as K
from orderly.operators import lexicon as X
from orderly.operators import spelling as X2
from orderly.operators import split as P
from orderly.plans.base import frames, micros, query, r6
from orderly.sources.tables import table


@query("F4_semitones", """WITH {FR} SELECT eid, round(12 * log2(f / 100), 6) AS st, round(100 * pow(2, 12 * log2(f / 100) / 12), 6) AS hz, round(20 * log10(greatest(value / 500, 1e-10)), 6) AS db, round_even(value, 0)::BIGINT AS near FROM fr""")
def semitones(spark, sf):
    st = S.semitones(F.col("f"))
    return frames(spark, sf).select("eid", r6(st).alias("st"), r6(S.from_semitones(st)).alias("hz"), r6(S.dbfs(F.col("value") / 500)).alias("db"), S.rint(F.col("value")).alias("near"))


@query("F9_regex", """SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]'))::INT AS han, regexp_extract(source, '([a-z]+)([0-9]*)', 1) AS stem, regexp_extract(source, '([a-z]+)([0-9]*)', 2) AS number, regexp_full_match(source, 'src1[0-9]') AS teen FROM documents""")
def regex(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(S.han(F.col("text"))).alias("han"), F.regexp_extract("source", "([a-z]+)([0-9]*)", 1).alias("stem"), F.regexp_extract("source", "([a-z]+)([0-9]*)", 2).alias("number"), F.col("source").rlike("^src1[0-9]$").alias("teen"))


@query("F11_strings", """SELECT p_partkey, trim(p_name) AS name, split_part(p_name, ' ', 1) AS first, len(string_split(p_name, ' '))::INT AS words, starts_with(p_type, 'S') AS s, substr(p_type, 2, 3) AS mid FROM part""")
def strings(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.trim("p_name").alias("name"), F.substring_index("p_name", " ", 1).alias("first"), F.size(F.split("p_name", " ")).alias("words"), F.col("p_type").startswith("S").alias("s"), F.substring("p_type", 2, 3).alias("mid"))


@query("F12_nfc", """SELECT item_id, nfc_normalize(replace(text, 'a', 'a' || chr(769))) AS t FROM benchmark""")
def nfc(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.nfc(F.replace("text", F.lit("a"), F.lit("á"))).alias("t"))


@query("F14_hash", """SELECT doc_id, 'reading_' || substr(sha256(text), 1, 20) AS id FROM documents""")
def hash_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("reading_"), F.substring(F.sha2("text", 256), 1, 20)).alias("id"))


@query("F15_json", """SELECT event_id, len(json_keys(props))::INT AS keys, array_to_string(list_sort(json_keys(props)), ',') AS names FROM events""")
def json(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.size(keys).alias("keys"), F.array_join(F.sort_array(keys), ",").alias("names"))


@query("F16_escape", """SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown, base64(encode(url)) AS b64 FROM pages""")
def escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_escape(F.col("url")).alias("shown"), S.base64_text(F.col("url")).alias("b64"))


@query("F18_rime_window", """WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS ph FROM part) SELECT p_partkey, array_to_string(list_filter(ph[2:], lambda x: x[1] <> 'P'), '-') AS rime FROM w""")
def rime_window(spark, sf):
    rest = F.slice(F.split("p_type", " "), F.lit(2), F.lit(1000))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.filter(rest, lambda x: ~x.startswith("P")), "-").alias("rime"))


@query("F19_argmax", """SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS at, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings""")
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.argmax(F.col("embedding")).alias("at"), r6(F.array_max("embedding").cast("double")).alias("top"))


@query("F19_logsoftmax", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT vec_id, (pos - 1)::INT AS pos, round(x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)), 6) AS lp FROM v""")
def logsoftmax(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.log_softmax(F.col("embedding"))).alias("pos", "lp"))
    return e.select("vec_id", "pos", r6("lp").alias("lp"))


@query("F19_logaddexp", """WITH {FR} SELECT eid, round(ln(exp(-strength) + 0.5 * exp(rms / 10)), 6) AS both_ FROM fr""")
def logaddexp(spark, sf):
    return frames(spark, sf).select("eid", r6(S.log_add(-F.col("strength"), F.col("rms") / 10)).alias("both_"))


@query("F20_znorm", """WITH {FR} SELECT eid, round((value - avg(value) OVER (PARTITION BY rec)) / sqrt(var_pop(value) OVER (PARTITION BY rec) + 1e-7), 6) AS z FROM fr""")
def znorm(spark, sf):
    w = Window.partitionBy("rec")
    return frames(spark, sf).select("eid", r6((F.col("value") - F.avg("value").over(w)) / F.sqrt(F.var_pop("value").over(w) + 1e-7)).alias("z"))


@query("F21_frame_time", """SELECT vec_id, round((vec_id * 320 + (400 - 1) / 2) / 16000, 6) AS t FROM embeddings""")
def frame_time(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6((F.col("vec_id") * 320 + F.lit((400 - 1) / 2)) / 16000).alias("t"))


@query("F22_learning_rate", """SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001::DOUBLE * (event_id + 1) / 100 ELSE 0.001::DOUBLE * greatest(0.0, (800 - event_id) / 700.0) END, 6) AS lr FROM events""")
def learning_rate(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.learning_rate(F.col("event_id"), 100, 800, 0.001)).alias("lr"))


@query("F25_map_inversion", """SELECT conv_id, role || ':' || length(text) AS k, max(turn) AS v FROM conversations GROUP BY 1, 2""")
def map_inversion(spark, sf):
    """turn to role and length as a map for each conversation, turned round; of equal values the last turn stays."""
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("v"))))
    one = table(spark, sf, "conversations").groupBy("conv_id").agg(F.map_from_entries(pairs).alias("m"))
    values = F.array_distinct(F.map_values("m"))
    turned = F.map_from_arrays(values, F.transform(values, lambda v: F.array_max(F.map_keys(F.map_filter("m", lambda _, w: w == v)))))
    return one.select("conv_id", F.explode(turned).alias("k", "v"))


@query("W19_collapse", """WITH c AS (SELECT conv_id, turn, length(text) % 3 AS x FROM conversations), r AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
SELECT conv_id, coalesce(string_agg(x, ' ' ORDER BY turn) FILTER (WHERE x <> 0 AND x IS DISTINCT FROM p), '') AS ids FROM r GROUP BY conv_id""")
def collapse(spark, sf):
    c = labels_by_conversation(spark, sf)
    return c.select("conv_id", F.array_join(S.collapse(F.col("x")).cast("array<string>"), " ").alias("ids"))


def labels_by_conversation(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.length("text") % 3).alias("x")))).alias("r"))
    return c.select("conv_id", F.transform("r", lambda r: r["x"]).alias("x"))


@query("W25_feasible", """WITH c AS (SELECT conv_id, turn, length(text) % 3 AS x FROM conversations), r AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
SELECT conv_id, (count(*) + count(*) FILTER (WHERE x = p))::INT AS need, 5 >= count(*) + count(*) FILTER (WHERE x = p) AS fits FROM r GROUP BY conv_id""")
def feasible(spark, sf):
    c = labels_by_conversation(spark, sf)
    need = S.feasible_frames(F.col("x"))
    return c.select("conv_id", need.alias("need"), (need <= 5).alias("fits"))


@query("FDP4_edit_distance", """SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INT AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def edit_distance(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("d"))


@query("J9_lexicon", """WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark), ch AS (SELECT item_id, (i - 1)::INT AS i, text[i] AS ch, text FROM c WHERE i <= length(text)),
w AS (SELECT n_name AS word, unnest(range(1, length(n_name) + 1)) AS j, lower(n_name) AS low FROM nation), m AS (SELECT item_id, i, word, j, (i + 1 - j >= 0 AND substr(text, i + 2 - j, length(word)) = low) AS whole FROM ch JOIN w ON low[j] = ch)
SELECT item_id, i, count(*) AS hits, count(*) FILTER (WHERE whole) AS whole FROM m GROUP BY item_id, i""")
def lexicon(spark, sf):
    texts = table(spark, sf, "benchmark").select("item_id", F.col("text"))
    words = table(spark, sf, "nation").select(F.lower("n_name").alias("word"))
    return X.hits(texts, words, "item_id", "text")


@query("J10_parse", """WITH i(initial, ii) AS (VALUES ('', ''), ('p', 'p'), ('ph', 'pʰ'), ('t', 't'), ('th', 'tʰ'), ('gh', 'ɦ')), f(final, fi) AS (VALUES ('a', 'a'), ('ha', 'ɦa'), ('i', 'i'), ('ng', 'ŋ')),
x AS (SELECT DISTINCT substr(lower(n_name), 1, 1) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey),
sp AS (SELECT DISTINCT p || q.c AS spelling FROM x q, (VALUES ('p'), ('ph'), ('t'), ('th'), (''), ('y'), ('n')) v(p) UNION SELECT 'ng' FROM x UNION SELECT 'xx' FROM x),
s AS (SELECT spelling, CASE WHEN spelling = 'xx' THEN 'pa' ELSE spelling END AS s FROM sp),
c AS (SELECT spelling, initial, final, ii || fi AS ipa, CASE WHEN s = 'ng' THEN 'special' WHEN s = 'yi' THEN 'conditioned' ELSE 'regular' END AS method FROM s JOIN i ON CASE WHEN s = 'ng' THEN initial = '' WHEN s = 'yi' THEN initial = 'gh' ELSE starts_with(s, initial) END
  JOIN f ON CASE WHEN s = 'ng' THEN final = 'ng' WHEN s = 'yi' THEN final = 'i' ELSE substr(s, length(initial) + 1) = final END)
SELECT s.spelling, CASE WHEN count(c.final) = 1 THEN max(initial) END AS initial, CASE WHEN count(c.final) = 1 THEN max(final) END AS final, CASE WHEN count(c.final) = 1 THEN max(ipa) END AS ipa,
  CASE WHEN count(c.final) = 1 THEN max(method) END AS method, count(c.final) AS parses FROM s LEFT JOIN c ON c.spelling = s.spelling GROUP BY s.spelling""")
def parse(spark, sf):
    """Spellings made of seven beginnings and the first letters of the nations that have customers."""
    initials = spark.sql("SELECT * FROM VALUES ('', ''), ('p', 'p'), ('ph', 'pʰ'), ('t', 't'), ('th', 'tʰ'), ('gh', 'ɦ') AS t(initial, initial_ipa)")
    finals = spark.sql("SELECT * FROM VALUES ('a', 'a'), ('ha', 'ɦa'), ('i', 'i'), ('ng', 'ŋ') AS t(final, final_ipa)")
    aliases = spark.sql("SELECT * FROM VALUES ('xx', 'pa') AS t(spelling, alias)")
    specials = spark.sql("SELECT * FROM VALUES ('ng', 'ng') AS t(spelling, final)")
    conditioned = spark.sql("SELECT * FROM VALUES ('yi', 'gh', 'i') AS t(spelling, initial, final)")
    here = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    letter = here.select(F.lower(F.left("n_name", F.lit(1))).alias("c")).distinct()
    made = F.transform(F.array(*map(F.lit, ("p", "ph", "t", "th", "", "y", "n"))), lambda p: F.concat(p, "c"))
    spelled = letter.select(F.explode(F.concat(made, F.array(F.lit("ng"), F.lit("xx")))).alias("spelling"))
    return X.parse_syllables(spelled, initials, finals, aliases, specials, conditioned)


MEDIALS, VOWELS = ("", "i", "u"), {"a": "ɑ", "e": "ɛ", "o": "ɔ", "i": "i", "u": "u"}
CODAS = {"": "", "n": "\u0303", "ng": "ŋ", "h": "ʔ", "q": "k", "s": "s", "t": "t", "r": "ɹ"}
ONSETS = {"": "", "b": "b", "p": "pʰ", "d": "d", "t": "tʰ", "l": "l", "s": "s", "si": "ɕ", "n": "n", "gh": "ɦ", "th": "θ", "w": "w"}
SQL_LIST = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())


def syllables() -> X2.Scheme:
    """A scheme whose finals are a medial, a vowel and a coda: 120 of them."""
    finals = {m + v + c: unicodedata.normalize("NFC", {"": "", "i": "j", "u": "w"}[m] + ipa + end) for m in MEDIALS for v, ipa in VOWELS.items() for c, end in CODAS.items()}
    return X2.Scheme(ONSETS, finals | {"m": "m\u0329"}, {"m": "m", "un": "m"}, {"ed": ("gh", "et")}, {"of": "o", "and": "an"})


@query("F17_convert", f"""WITH o(o, oi) AS (VALUES {SQL_LIST(ONSETS)}), m(m, mi) AS (VALUES ('', ''), ('i', 'j'), ('u', 'w')), v(v, vi) AS (VALUES {SQL_LIST(VOWELS)}), c(c, ci) AS (VALUES {SQL_LIST(CODAS)}),
f AS (SELECT m || v || c AS f, mi || vi || ci AS fi, length(mi) + 1 + CASE WHEN c IN ('', 'n') THEN 0 ELSE 1 END AS n FROM m, v, c UNION ALL SELECT 'm', 'm' || chr(809), 1),
w AS (SELECT o || f AS s, o, f, oi || fi AS ipa, n + CASE WHEN oi = '' THEN 0 ELSE 1 END AS n, count(*) OVER (PARTITION BY o || f) AS ways FROM o, f),
whole(s, o, f, method) AS (VALUES ('m', '', 'm', 'special'), ('un', '', 'm', 'special'), ('ed', 'gh', 'et', 'conditioned')),
known AS (SELECT s, o, f, ipa, n, ways, 'regular' AS method FROM w WHERE s NOT IN (SELECT s FROM whole)
  UNION ALL SELECT whole.s, whole.o, whole.f, oi || fi, n + CASE WHEN oi = '' THEN 0 ELSE 1 END, 1, method FROM whole JOIN o USING (o) JOIN f USING (f)),
one AS (SELECT s, max(ways) AS ways, max(ipa) AS ipa, max(n) AS n, max(method) AS method FROM known GROUP BY s),
t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[^ \\n\\r\\t]+')) AS raw FROM conversations),
p AS (SELECT *, CASE s WHEN 'of' THEN 'o' WHEN 'and' THEN 'an' ELSE s END AS named FROM (SELECT *, regexp_extract(raw, '^([a-zɡ]+)[0-9]*$', 1) AS s FROM t)),
j AS (SELECT p.*, one.ipa, one.n, one.method, CASE WHEN p.s = '' THEN 'malformed' WHEN one.s IS NULL THEN 'unknown' WHEN ways > 1 THEN 'ambiguous' END AS error FROM p LEFT JOIN one ON one.s = p.named)
SELECT conv_id, turn, coalesce(error, method) AS outcome, count(*) AS tokens, coalesce(sum(n) FILTER (error IS NULL), 0)::BIGINT AS phones, coalesce(string_agg(DISTINCT nfc_normalize(ipa), ' ' ORDER BY nfc_normalize(ipa)) FILTER (error IS NULL), '') AS ipa
FROM j GROUP BY conv_id, turn, outcome""")
def converted(spark, sf):
    """Every turn as an utterance: how many of its words are syllables of the scheme or fail, the phones they take up, and their transcriptions."""
    found = X2.convert(table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("text")), "text", syllables())
    each = found.select("conv_id", "turn", F.explode("syllables").alias("s")).select("conv_id", "turn", "s.*")
    return each.groupBy("conv_id", "turn", F.coalesce("error", "method").alias("outcome")).agg(
        F.count("*").alias("tokens"), F.sum(F.col("end") - F.col("start")).alias("phones"), F.array_join(F.sort_array(F.collect_set("ipa")), " ").alias("ipa")
    )


@query("P4_candidates", """SELECT doc_id, n_chars FROM documents WHERE n_chars >= 800 AND n_chars <= 3000 AND length(regexp_extract_all(text, '[.]')::VARCHAR) > 0 AND len(regexp_extract_all(text, '[.]')) > 8""")
def candidates(spark, sf):
    dots = F.regexp_count("text", F.lit("[.]"))
    return table(spark, sf, "documents").where(F.col("n_chars").between(800, 3000) & (dots > 8)).select("doc_id", "n_chars")


@query("P6_status", """WITH h AS (SELECT sha256(text) AS h, count(DISTINCT lang) AS k FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'excluded_missing_audio' WHEN k > 1 THEN 'excluded_duplicate_audio_conflict' WHEN doc_id % 7 = 0 THEN 'excluded_explicit' ELSE 'ready' END AS status FROM documents JOIN h ON h.h = sha256(text)""")
def status(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    conflicts = docs.groupBy("h").agg(F.count_distinct("lang").alias("k"))
    rows = docs.join(conflicts, "h")
    return rows.select("doc_id", P.status(F.col("doc_id") % 41 == 0, F.col("k") > 1, F.col("doc_id") % 7 == 0).alias("status"))


@query("P7_flags", """SELECT doc_id, concat_ws(';', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END) AS issues FROM documents""")
def flag_list(spark, sf):
    named = S.flags((F.col("n_chars") < 100, "short"), (F.col("n_chars") > 5000, "long"), (F.col("lang") != "en", "foreign"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(named, ";").alias("issues"))


@query("P8_classes", """SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN 'aspirated' WHEN p_type LIKE 'P%' THEN 'plain' ELSE 'other' END || CASE WHEN contains(p_name, 'i') THEN '_i' ELSE '_no_i' END AS grp FROM part""")
def classes(spark, sf):
    kind = F.when(F.col("p_type").startswith("S"), "aspirated").when(F.col("p_type").startswith("P"), "plain").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", F.concat(kind, F.when(F.col("p_name").contains("i"), "_i").otherwise("_no_i")).alias("grp"))


@query("P14_weak", """WITH {FR} SELECT rec, (i - 1) // 12 AS tok, round(avg(strength), 6) AS score, round(max(strength), 6) AS peak FROM fr GROUP BY 1, 2 HAVING avg(strength) < 0.4 OR max(strength) < 0.8""")
def weak(spark, sf):
    g = frames(spark, sf).groupBy("rec", F.expr("(i - 1) div 12").alias("tok")).agg(S.ordered_avg("strength", "i").alias("score"), F.max("strength").alias("peak"))
    return g.where("score < 0.4 OR peak < 0.8").select("rec", "tok", r6("score").alias("score"), r6("peak").alias("peak"))


@query("P17_paths", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', CASE WHEN page_id % 9 = 0 THEN '../' WHEN page_id % 9 = 1 THEN '/' ELSE '' END) AS path FROM pages)
SELECT page_id, NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AND NOT regexp_matches(path, '\\\\|^[A-Za-z]:') AS safe FROM p""")
def paths(spark, sf):
    cut = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    path = F.concat(F.when(F.col("page_id") % 9 == 0, "../").when(F.col("page_id") % 9 == 1, "/").otherwise(""), cut)
    return table(spark, sf, "pages").select("page_id", S.safe_path(path).alias("safe"))


@query("P19_sensitivity", """WITH {FR} SELECT rec, i, abs(t - lag(t) OVER (PARTITION BY rec, kind ORDER BY i)) > 0.1::DOUBLE AS far FROM fr""")
def sensitivity(spark, sf):
    before = F.lag("t").over(Window.partitionBy("rec", "kind").orderBy("i"))
    return frames(spark, sf).select("rec", "i", (F.abs(F.col("t") - before) > 0.1).alias("far"))


@query("P20_variants", """WITH v AS (SELECT p_partkey, p_type AS reading, 0 AS variant FROM part UNION ALL SELECT p_partkey, left(p_type, length(p_type) - 1), 1 FROM part WHERE p_type LIKE '%D' AND length(p_type) > 1) SELECT * FROM v""")
def variants(spark, sf):
    rows = F.array(F.struct(F.col("p_type").alias("reading"), F.lit(0).alias("variant")), F.when(F.col("p_type").endswith("D") & (F.length("p_type") > 1), F.struct(F.expr("left(p_type, length(p_type) - 1)").alias("reading"), F.lit(1).alias("variant"))))
    return table(spark, sf, "part").select("p_partkey", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("v")).select("p_partkey", "v.*")


@query("V1_unique", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def unique(spark, sf):
    return K.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("V2_orphans", """SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)""")
def orphans(spark, sf):
    return K.orphans(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("doc_id % 11 != 0"), "doc_id", "doc_id")


@query("V3_dense", """SELECT min(doc_id) = 0 AS starts_at_0, max(doc_id) - min(doc_id) + 1 = count(doc_id) AND count(DISTINCT doc_id) = count(doc_id) AS dense, count(doc_id) AS n FROM documents""")
def dense(spark, sf):
    return K.dense_ids(table(spark, sf, "documents"), "doc_id")


@query("V4_row_counts", """SELECT count(*) AS docs, count(*) FILTER (WHERE n_chars = length(text)) AS exact FROM documents""")
def row_counts(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("docs"), F.count_if(F.col("n_chars") == F.length("text")).alias("exact"))


@query("V5_fingerprint", """WITH e AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) AS us, round(value * 100)::BIGINT AS cents FROM events),
h AS (SELECT ('0x' || substr(sha256(concat_ws('|', """ + ", ".join(f"length({c}::VARCHAR) || ':' || {c}::VARCHAR" for c in ("event_id", "user_id", "event_type", "props", "us", "cents")) + """)), 1, 15))::BIGINT AS h FROM e)
SELECT count(*) AS n, sum(h)::VARCHAR AS fingerprint FROM h""")
def fingerprint(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return K.fingerprint(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props", micros(F.col("ts")).alias("us"), cents))


@query("V7_tiling", """WITH c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole, sum(length(text)) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, n::BIGINT = length(whole) AS tiles, sha256(whole) AS h FROM c""")
def span_tiling(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    whole = F.array_join(F.transform("r", lambda r: r["text"]), "")
    return c.select("conv_id", (F.col("n") == F.length(whole)).alias("tiles"), F.sha2(whole, 256).alias("h"))


@query("V8_split_hash", """WITH b AS (SELECT doc_id, ('0x' || substr(sha256('1' || source || doc_id % 50), 1, 8))::BIGINT % 100 AS b FROM documents) SELECT doc_id, CASE WHEN b < 10 THEN 'dev' WHEN b < 20 THEN 'test' ELSE 'train' END AS split FROM b""")
def split_hash(spark, sf):
    group = F.concat("source", (F.col("doc_id") % 50).cast("string"))
    return table(spark, sf, "documents").select("doc_id", P.by_hash(group).alias("split"))


@query("V8_split_greedy")
def split_greedy(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat("source", F.lit("_"), (F.col("doc_id") % 40).cast("string")).alias("grp"), F.array("lang", F.lower(F.substring("text", 1, 1))).alias("tokens"))
    return P.greedy(docs, "grp", "tokens")


@query("V10_tolerance", """WITH {FR} SELECT rec, i FROM fr WHERE abs(t - round(t, 1)) > 0.045::DOUBLE""")
def tolerance(spark, sf):
    return frames(spark, sf).where(F.abs(F.col("t") - F.round("t", 1)) > 0.045).select("rec", "i")
