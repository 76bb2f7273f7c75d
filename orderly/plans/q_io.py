"""Queries that write and read back, and the rest of the row-wise operators."""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.functions import tables as TF
from orderly.operators import intervals as I
from orderly.operators import seqdp as D
from orderly.operators.quantiles import exact
from orderly.plans.base import frames, query, r6, tokens
from orderly.session import materialize, shared_dir
from orderly.sources import archives as Z
from orderly.sources import files as B
from orderly.sources import readers as R
from orderly.sources import writers as W
from orderly.sources.tables import table


def place(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


def texts_as_csv(spark, sf):
    """The folder of documents written as CSV with whole texts, line ends and quotes in them."""
    path = place(spark)
    rows = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), "text", "lang", "source")
    rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("emptyValue", "").csv(path)
    return path


@query("S2_csv_round_trip", """SELECT doc_id, text, lang FROM documents""")
def csv_round_trip(spark, sf):
    """Whole texts through CSV, with their quotes, commas and line ends."""
    back = R.strict_csv(spark, texts_as_csv(spark, sf), ["id", "text", "lang", "source"], "id", "[0-9]{9}")
    return back.select(F.col("id").cast("long").alias("doc_id"), "text", "lang")


@query("S3_lexicon", """SELECT c_name AS word, lower(c_name) AS first, 'csv' AS source FROM customer UNION ALL SELECT p_name, string_split(lower(p_type), ' ')[1], 'tsv' FROM part""")
def lexicon(spark, sf):
    one, two = place(spark), place(spark)
    c = table(spark, sf, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.lit("x"), F.lit("y"), F.lit("z"), F.lower("c_name")).alias("value"))
    c.unionByName(table(spark, sf, "customer").select(F.lit("too,short").alias("value"))).write.text(one)
    table(spark, sf, "part").select(F.concat_ws("\t", "p_name", F.lower("p_type")).alias("value")).write.text(two)
    return R.lexicon(spark, one, two).select("word", F.col("syllables")[0].alias("first"), "source")


@query("S7_jsonl_by_split", """SELECT conv_id, turn, role, length(text)::INT AS n FROM conversations""")
def jsonl_by_split(spark, sf):
    path = place(spark)
    W.json_by(table(spark, sf, "conversations"), path, "role")
    back = R.json_lines(spark, path, "conv_id long, turn long, text string, role string")
    return back.select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("S15_markdown", """SELECT conv_id, role, length(text)::VARCHAR AS n FROM conversations""")
def markdown(spark, sf):
    """Every conversation as a text with a pipe table, parsed back."""
    row = F.struct("turn", F.concat(F.lit("| "), "role", F.lit(" | "), F.length("text").cast("string"), F.lit(" |")).alias("s"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    text = F.concat_ws("\n", F.lit("# turns"), F.lit("| role | n |"), F.lit("|:---|---:|"), F.array_join(F.transform("r", lambda x: x["s"]), "\n"))
    rows = R.markdown_rows(c.select("conv_id", text.alias("text")), "conv_id", "text").where("line > 1")
    return rows.select("conv_id", F.col("cells")[0].alias("role"), F.col("cells")[1].alias("n"))


@query("S15_lateral", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) + 2 AS line, role, length(text)::VARCHAR AS n FROM conversations""")
def markdown_in_sql(spark, sf):
    """The same tables through SQL: a table function over whole texts with LATERAL, and one over their lines by PARTITION BY, which must agree."""
    TF.register(spark)
    row = F.struct("turn", "role", F.length("text").alias("n"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["role"], F.lit(" | "), x["n"].cast("string"), F.lit(" |"))), "\n")
    texts = c.select("conv_id", F.concat_ws("\n", F.lit("# turns"), F.lit("| role | n |"), F.lit("|:---|---:|"), body, F.lit("end")).alias("text"))
    lines = texts.select("conv_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    one = spark.sql("SELECT t.conv_id, p.line, p.role, p.n FROM {t} t, LATERAL pipe_rows(t.text, 'role | n') p", t=texts)
    two = spark.sql("SELECT conv_id, line, role, n FROM pipe_lines(TABLE(SELECT conv_id, line, text FROM {l}) PARTITION BY conv_id ORDER BY (line), 'role | n')", l=lines)
    return one.intersectAll(two)


@query("K1_json", """SELECT c_custkey, c_name, round(c_acctbal, 6) AS balance FROM customer""")
def json_sink(spark, sf):
    """Strict JSON, published at once over what was there, and read back."""
    path = place(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    W.publish(rows.limit(0), path)
    W.publish(rows, path)
    return R.json_lines(spark, path, "c_custkey long, c_name string, c_acctbal double").select("c_custkey", "c_name", r6("c_acctbal").alias("balance"))


@query("S6_json_documents", """SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def json_documents(spark, sf):
    """A JSON document for every 50 conversations, indented and over many lines, found by a pattern."""
    path = place(spark)
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))).alias("turns"))
    parts = turns.groupBy(F.floor(F.col("conv_id") / 50).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("conv_id", "turns")).alias("docs")), {"pretty": "true"}).alias("value"))
    parts.write.partitionBy("part").option("lineSep", "\n").text(path)
    back = R.json_documents(spark, f"{path}/part=*/*.txt", "docs array<struct<conv_id:long,turns:array<struct<turn:long,n:long>>>>")
    docs = back.select(F.explode("docs").alias("d")).select("d.*")
    return docs.select("conv_id", F.size("turns").cast("long").alias("turns"), F.expr("aggregate(turns, 0L, (s, t) -> s + coalesce(t.n, 0L))").alias("chars"))


@query("K3_csv_union", """SELECT 'a' AS kind, s_suppkey AS key, s_name AS name, NULL::VARCHAR AS tags FROM supplier UNION ALL SELECT 'b', c_custkey, NULL, '["' || c_name || '","' || c_nationkey || '"]' FROM customer""")
def csv_union(spark, sf):
    path = place(spark)
    a = table(spark, sf, "supplier").select(F.lit("a").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = table(spark, sf, "customer").select(F.lit("b").alias("kind"), F.col("c_custkey").alias("key"), F.array("c_name", F.col("c_nationkey").cast("string")).alias("tags"))
    W.csv_union([a, b], path)
    return R.csv(spark, path, "kind string, key long, name string, tags string", exact=True)


@query("K5_rounded_gzip", """WITH {FR} SELECT eid, round(f, 3) AS f, round(t, 2) AS t FROM fr""")
def rounded(spark, sf):
    path = place(spark)
    W.csv_rounded(frames(spark, sf).select("eid", "f", "t"), path, {"f": 3, "t": 2})
    return R.csv(spark, path, "eid long, f double, t double", exact=True)


@query("K6_tsv", """SELECT p_partkey, p_type FROM part""")
def tsv(spark, sf):
    path = place(spark)
    table(spark, sf, "part").select("p_partkey", "p_type").write.option("header", "true").option("sep", "\t").csv(path)
    return spark.read.schema("p_partkey long, p_type string").option("header", "true").option("sep", "\t").csv(path)


@query("K10_text_grid", """WITH {FR}, {TOK}, s AS (SELECT rec, tok, a AS xmin, a + 0.07::DOUBLE AS xmax FROM tok), e AS (SELECT rec, max(t) + 1 AS stop FROM fr GROUP BY rec),
g AS (SELECT s.rec, coalesce(lag(xmax) OVER (PARTITION BY s.rec ORDER BY xmin), 0) AS lo, xmin AS hi FROM s UNION ALL SELECT s.rec, max(xmax), max(stop) FROM s JOIN e ON e.rec = s.rec GROUP BY s.rec)
SELECT rec, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, 'say "' || tok || '"' AS label FROM s UNION ALL SELECT rec, round(lo, 6), round(hi, 6), '' FROM g WHERE hi > lo""")
def text_grid(spark, sf):
    """Token tiers written as interval text grids and read back."""
    fr = frames(spark, sf)
    label = F.concat(F.lit('say "'), F.col("tok").cast("string"), F.lit('"'))
    spans = tokens(fr).select("rec", label.alias("label"), F.col("a").alias("s"), (F.col("a") + F.lit(0.07)).alias("e"))
    spans = spans.join(fr.groupBy("rec").agg((F.max("t") + 1).alias("stop")), "rec")
    grids = W.text_grids(I.tiling(spans, "rec", "s", "e", "label", F.lit(0.0), F.col("stop")), "rec")
    return grids.select("rec", F.explode(W.read_text_grid(F.col("text"))).alias("x")).select("rec", r6("x.xmin").alias("xmin"), r6("x.xmax").alias("xmax"), "x.label")


@query("K10_tiers", """WITH {FR}, {TOK}, s AS (SELECT rec, tok, a AS xmin, a + 0.07::DOUBLE AS xmax FROM tok), e AS (SELECT rec, max(t) + 1 AS stop FROM fr GROUP BY rec),
iv AS (SELECT rec, 1 AS number, 'tokens' AS tier, xmin, xmax, 'say "' || tok || '"' AS label FROM s UNION ALL SELECT rec, 3, 'halves', xmin, xmin + 0.035::DOUBLE, '[' || tok || ']' FROM s),
g AS (SELECT rec, number, tier, coalesce(lag(xmax) OVER (PARTITION BY rec, number ORDER BY xmin), 0) AS lo, xmin AS hi FROM iv UNION ALL SELECT iv.rec, number, tier, max(xmax), max(stop) FROM iv JOIN e ON e.rec = iv.rec GROUP BY iv.rec, number, tier
  UNION ALL SELECT e.rec, x.number, x.tier, 0, stop FROM e, (VALUES (1, 'tokens'), (3, 'halves'), (4, 'notes')) x(number, tier) WHERE x.number = 4 OR e.rec NOT IN (SELECT rec FROM s)),
a AS (SELECT rec, number, tier, 'interval' AS kind, xmin, xmax, label FROM iv UNION ALL SELECT rec, number, tier, 'interval', lo, hi, '' FROM g WHERE hi > lo UNION ALL SELECT rec, 2, 'onsets', 'point', xmin, xmin, tok::VARCHAR FROM s)
SELECT rec, number::INT AS number, tier, kind, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, label FROM a""")
def tiers(spark, sf):
    """Grids of four tiers: tokens, their onsets as points, their first halves, and one without entries; written and read back."""
    fr = frames(spark, sf)
    tok, a = F.col("tok").cast("string"), F.col("a")
    t = tokens(fr)
    rows = [
        t.select("rec", F.lit("tokens").alias("tier"), a.alias("xmin"), (a + F.lit(0.07)).alias("xmax"), F.concat(F.lit('say "'), tok, F.lit('"')).alias("label")),
        t.select("rec", F.lit("onsets").alias("tier"), a.alias("xmin"), a.alias("xmax"), tok.alias("label")),
        t.select("rec", F.lit("halves").alias("tier"), a.alias("xmin"), (a + F.lit(0.035)).alias("xmax"), F.concat(F.lit("["), tok, F.lit("]")).alias("label")),
    ]
    spans = fr.groupBy("rec").agg(F.lit(0.0).alias("from"), (F.max("t") + 1).alias("to"))
    grids = W.tiered_grids(rows[0].unionByName(rows[1]).unionByName(rows[2]), spans, "rec", [("tokens", "interval"), ("onsets", "point"), ("halves", "interval"), ("notes", "interval")])
    return grids.select("rec", F.inline(W.read_tiers("text"))).withColumns({c: r6(c) for c in ("xmin", "xmax")})


@query("K14_report", """WITH {FR}, c AS (SELECT kind, count(*) AS n FROM fr GROUP BY kind) SELECT '| kind | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || kind || ' | ' || n || ' |', chr(10) ORDER BY kind) AS report FROM c""")
def report(spark, sf):
    return W.markdown(frames(spark, sf).groupBy("kind").agg(F.count("*").alias("n")), ["kind"])


@query("P11_override", """SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal < 0 THEN 0 ELSE round(c_acctbal, 6) END AS balance FROM customer""")
def override(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("x"))
    merged = rows.withColumn("x", F.col("x").withField("c_acctbal", F.when(F.col("x.c_acctbal") < 0, 0.0).otherwise(F.col("x.c_acctbal"))))
    return merged.select("c_custkey", F.col("x.c_name").alias("name"), r6("x.c_acctbal").alias("balance"))


@query("P12_pivot", """WITH {FR} SELECT rec, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "signup")) + " FROM fr GROUP BY rec")
def pivot(spark, sf):
    kinds = ["click", "error", "purchase", "signup"]
    wide = frames(spark, sf).groupBy("rec").pivot("kind", kinds).agg(F.count("eid"))
    return wide.select("rec", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


@query("P15_routing", """WITH {FR} SELECT CASE WHEN strength >= 0.6 THEN 'auto' WHEN strength >= 0.3 THEN 'tentative' ELSE 'uncertain' END AS tier, count(*) AS n, sum(eid)::BIGINT AS ids FROM fr GROUP BY 1""")
def routing(spark, sf):
    tier = F.when(F.col("strength") >= 0.6, "auto").when(F.col("strength") >= 0.3, "tentative").otherwise("uncertain")
    return frames(spark, sf).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("eid").alias("ids"))


@query("P16_private_keys", """WITH j AS (SELECT event_id, '{"outer": [1, {"deep": ' || props || '}], "at": "' || CASE WHEN event_id % 5 = 0 THEN '/tmp/x' ELSE 'x' END || '"}' AS j FROM events)
SELECT j.event_id, bool_or(coalesce(t.key, '') IN ('k', 'secret') OR (t.type = 'VARCHAR' AND t.atom->>'$' LIKE '/%')) AS private FROM j, json_tree(j.j::JSON) t GROUP BY j.event_id""")
def private_keys(spark, sf):
    end = F.when(F.col("event_id") % 5 == 0, "/tmp/x").otherwise("x")
    nested = F.concat(F.lit('{"outer": [1, {"deep": '), "props", F.lit('}], "at": "'), end, F.lit('"}'))
    return table(spark, sf, "events").select("event_id", S.private_json(("k", "secret"))(nested).alias("private"))


@query("P5_filters", """SELECT doc_id, doc_id IN (3, 5, 8) AS listed, regexp_matches(source, '^src[0-9]') AS prefixed FROM documents WHERE doc_id IN (3, 5, 8) OR doc_id BETWEEN 20 AND 400 AND regexp_matches(source, '^src[0-9]')""")
def filters(spark, sf):
    listed, prefixed = F.col("doc_id").isin(3, 5, 8), F.col("source").rlike("^src[0-9]")
    return table(spark, sf, "documents").where(listed | F.col("doc_id").between(20, 400) & prefixed).select("doc_id", listed.alias("listed"), prefixed.alias("prefixed"))


@query("P12_prefixed", """WITH {FR} SELECT rec, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_n, round(max(f) FILTER (WHERE kind = '{k}'), 6) AS {k}_top" for k in ("click", "purchase", "signup")) + " FROM fr GROUP BY rec")
def prefixed_columns(spark, sf):
    """A column for each measure of each kind, named by both."""
    found = frames(spark, sf).groupBy("rec").agg(
        *[c for k in ("click", "purchase", "signup") for c in (F.count_if(F.col("kind") == k).alias(f"{k}_n"), r6(F.max(F.when(F.col("kind") == k, F.col("f")))).alias(f"{k}_top"))]
    )
    return found


@query("A24_summary", """WITH t AS (SELECT conv_id, role, CASE WHEN length(text) > 200 THEN 'long' WHEN length(text) = 0 THEN 'empty' ELSE 'plain' END AS status FROM conversations)
SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS parents, count(*) FILTER (WHERE status = 'long') AS long, count(*) FILTER (WHERE status = 'empty') AS empty FROM t GROUP BY role""")
def summaries(spark, sf):
    """Counts by status over the children that parents hold as arrays."""
    size = F.length("text")
    status = F.when(size > 200, "long").when(size == 0, "empty").otherwise("plain")
    parents = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", status.alias("status"))).alias("turns"))
    turns = parents.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    return turns.groupBy("role").agg(
        F.count("*").alias("turns"), F.countDistinct("conv_id").alias("parents"), F.count_if(F.col("status") == "long").alias("long"), F.count_if(F.col("status") == "empty").alias("empty")
    )


@query("F23_budget", """WITH {FR} SELECT eid, round(greatest(0.0::DOUBLE, least(6000.0::DOUBLE, 6500.0::DOUBLE - (us // 1000000) % 7000)), 6) AS left_s, us >= 1209600000000 AS after FROM fr""")
def budgets(spark, sf):
    """What is left of a time budget, and whether a date has passed."""
    fr = frames(spark, sf)
    elapsed = F.expr("us div 1000000") % 7000
    passed = F.timestamp_seconds(F.lit(1_704_067_200) + F.expr("us div 1000000")) >= F.timestamp_seconds(F.lit(1_705_276_800))  # 15 January 2024
    return fr.select("eid", r6(S.budget_left(elapsed, 6000.0, 6500.0)).alias("left_s"), passed.alias("after"))


@query("FDP4_token_distance", """WITH RECURSIVE p AS (SELECT x.item_id, string_split(x.text, ' ') AS a, string_split(y.text, ' ') AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1),
d AS (SELECT item_id, 0::BIGINT AS i, range(0, len(b) + 1) AS c FROM p
  UNION ALL SELECT item_id, i, list_transform(range(1, len(w) + 1), lambda j: list_min(list_transform(w[1:j], lambda v, k: v - k)) + j) FROM (
    SELECT d.item_id, d.i + 1 AS i, list_prepend(d.i + 1, list_transform(range(1, len(b) + 1), lambda j: least(c[j] + (b[j] <> a[d.i + 1])::INT, c[j + 1] + 1))) AS w FROM d JOIN p USING (item_id) WHERE d.i < len(a)))
SELECT item_id, c[len(b) + 1]::INT AS d FROM d JOIN p USING (item_id) WHERE i = len(a)""")
def token_distance(spark, sf):
    """Edit distance of neighbouring texts, word by word."""
    words = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    following = words.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return words.join(following, "item_id").select("item_id", D.token_distance("w", "v").alias("d"))


@query("S2_strict", """SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, lang, source, len(regexp_extract_all(text, '\\r\\n|\\n|\\r')) + 1 AS lines, true AS placed FROM documents""")
def strict_csv(spark, sf):
    """Records with ids that fit a pattern and occur once, and the lines of its file on which each stands: every record of a file begins behind the last line of the one before."""
    back = R.strict_csv(spark, texts_as_csv(spark, sf), ["id", "text", "lang", "source"], "id", "[0-9]{9}")
    follows = F.col("line") == F.coalesce(F.lag("last_line").over(Window.partitionBy("path").orderBy("record")), F.lit(1)) + 1
    return back.select("id", "lang", "source", (F.col("last_line") - F.col("line") + 1).alias("lines"), follows.alias("placed"))


@query("P21_remap", """WITH w AS (SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda x: CASE WHEN x[1] = 'P' AND len(x) > 1 THEN x[2:] ELSE x END) AS ph FROM part)
SELECT p_partkey, array_to_string(ph, ' ') AS phones, list_bool_and(list_transform(ph, lambda x: x[1] <> 'S')) AS known FROM w""")
def remap(spark, sf):
    parts = F.transform(F.split("p_type", " "), lambda x: F.when(x.startswith("P") & (F.length(x) > 1), x.substr(F.lit(2), F.length(x))).otherwise(x))
    rows = table(spark, sf, "part").select("p_partkey", parts.alias("ph"))
    return rows.select("p_partkey", F.array_join("ph", " ").alias("phones"), F.forall("ph", lambda x: ~x.startswith("S")).alias("known"))


@query("P22_saturation", """WITH {FR}, b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM fr) SELECT rec, bool_or(value < lo OR value > hi) AS any_out, round(count(*) FILTER (WHERE value >= lo AND value <= hi) / greatest(count(*), 1), 6) AS coverage FROM fr, b GROUP BY rec""")
def saturation(spark, sf):
    fr = frames(spark, sf)
    lo, hi = (F.lit(x).cast("double") for x in exact(fr, F.col("value"), (0.05, 0.95)))
    out = (F.col("value") < lo) | (F.col("value") > hi)
    return fr.groupBy("rec").agg(F.bool_or(out).alias("any_out"), r6(S.ratio(F.count_if(~out), F.count("*"))).alias("coverage"))


def emissions(spark, sf):
    """Vectors as emissions in blocks of 24."""
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 24).alias("utt"), "vec_id", F.col("embedding").alias("logp"))


def readings(utt: int) -> list[list[list[int]]]:
    """Three characters with two readings of two labels each."""
    return [[[1 + (utt + 9 * c + k) % 60, 1 + (utt + 9 * c + 3 * k) % 60] for k in (1, 2)] for c in range(3)]


@query("FDP2_lattice")
def lattice(spark, sf):
    """The readings on the best path of each utterance, among all and with the first of each character only."""

    def one(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        logp = np.array(rows.sort_values("vec_id")["logp"].tolist(), float)
        out = {"utt": ids[0], "readings": None, "score": None, "first_score": None}
        try:
            path = D.lattice_path(logp, readings(ids[0]))
            out |= {"readings": pd.Series(path.option).groupby(path.char).max().drop(-1, errors="ignore").tolist(), "score": round(path.score, 6)}
            out["first_score"] = round(D.lattice_path(logp, readings(ids[0]), first_only=True).score, 6)
        except ValueError:
            pass
        return pd.DataFrame([out])

    return emissions(spark, sf).groupBy("utt").applyInPandas(one, "utt long, readings array<int>, score double, first_score double")


@query("FDP5_evidence")
def path_evidence(spark, sf):
    """What the best path of each utterance says of its characters: one row each; utterances without a path have none."""
    schema = "utt long, char int, option int, start double, end double, anchor double, posterior double, labels array<struct<label:int,start:double,end:double,peak:double>>"

    def one(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        logp = np.array(rows.sort_values("vec_id")["logp"].tolist(), float)
        logp -= np.logaddexp.reduce(logp, axis=1, keepdims=True)
        try:
            path = D.lattice_path(logp, readings(ids[0]))
        except ValueError:
            return pd.DataFrame(columns=["utt", "char", "option", "start", "end", "anchor", "posterior", "labels"])
        centres = (np.arange(len(logp)) * 320 + 199.5) / 16000
        return pd.DataFrame([{"utt": ids[0], **c} for c in D.evidence(logp, path, centres, 0.02, len(logp) * 0.02)])

    return emissions(spark, sf).groupBy("utt").applyInPandas(one, schema)


@query("V6_manifest", """SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents""")
def manifest(spark, sf):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("V9_compatible", """SELECT count(*) = count(*) FILTER (WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id AND d.lang IS NOT DISTINCT FROM l.lang) AS same, count(*) AS n FROM documents d FULL JOIN (SELECT doc_id, lang FROM documents) l ON l.doc_id = d.doc_id""")
def compatible(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    other = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("lang").eqNullSafe(F.col("l"))
    return d.join(other, F.col("doc_id") == F.col("id"), "full_outer").agg((F.count("*") == F.count_if(same)).alias("same"), F.count("*").alias("n"))


def put(folder: str, name: str, data: bytes, at: int = 0) -> int:
    """Bytes into a file of the shared folder, which executors see as a local one, from a place on: what a lost attempt left behind it goes. Gives the size."""
    where = folder.removeprefix("file:").replace("///", "/", 1)
    os.makedirs(where, exist_ok=True)
    with open(f"{where}/{name}", "r+b" if at else "wb") as f:
        f.seek(at)
        f.truncate()
        f.write(data)
        return f.tell()


@query("S14_tail", """SELECT event_id, user_id, event_type FROM events""")
def tail_growing_files(spark, sf):
    """Events in JSON logs that grow while a stream tails them by bytes, with broken lines, and with a last line that is torn when the stream first reads it. The stream is
    started anew for each of three parts."""
    base = place(spark)
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("log", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    stream = B.parsed_json(B.tail_lines(spark, f"{base}/logs", ".jsonl", 1 << 20), "event_id long, user_id long, event_type string")
    ends = {}

    def grow(part: int, ends: dict[int, int]):
        """Adds a part's lines to a log. All but the last part end within a line, which the next one takes up."""

        def add(group: pd.DataFrame) -> pd.DataFrame:
            log = int(group["log"].iloc[0])
            head = b'": 3, "odd": true}\n' if ends.get(log) else b""  # makes the torn line one without an event
            data = head + b"no json\n" + "\n".join(group["line"]).encode() + b"\n" + (b"" if part == 2 else b'{"event')
            return pd.DataFrame({"log": [log], "size": [put(f"{base}/logs", f"{log}.jsonl", data, ends.get(log, 0))]})

        return add

    for part in range(3):
        some = rows.where(F.pmod("event_id", F.lit(3)) == part).select("log", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("line"))
        ends = ends | {r["log"]: r["size"] for r in materialize(some.groupBy("log").applyInPandas(grow(part, ends), "log long, size long")).collect()}  # four logs
        stream.writeStream.format("parquet").trigger(availableNow=True).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start().awaitTermination()
    return spark.read.parquet(f"{base}/out").where("event_id IS NOT NULL")


VECTORS_A_FILE = 100


def vectors_as_files(spark, sf, wav: bool) -> str:
    """The folder of files that hold 100 vectors each, 64 numbers of 4 bytes a vector, or of 2 bytes behind the header of a WAV file."""
    base = place(spark)
    rows = table(spark, sf, "embeddings").select((F.floor(F.col("vec_id") / VECTORS_A_FILE)).alias("file"), "vec_id", "embedding")

    def write(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(group.sort_values("vec_id")["embedding"].to_numpy())
        data, name = values.astype("<f4").tobytes(), f"{int(group['file'].iloc[0]):06d}"
        if wav:
            data = np.rint(values * 1000).astype("<i2").tobytes()
            rate, channels = 8000 + int(group["file"].iloc[0]), 2
            data = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(data)) + data
        put(base, f"{name}.{'wav' if wav else 'f32'}", data)
        return pd.DataFrame({"n": [len(data)]})

    materialize(rows.groupBy("file").applyInPandas(write, "n long"))
    return base


@query("S10_range_scan", """WITH v AS (SELECT vec_id, embedding, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS k FROM embeddings)
SELECT (vec_id // 100)::BIGINT AS file, k, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM v WHERE k BETWEEN 20 AND 39""")
def range_scan(spark, sf):
    """The vectors 20 to 39 of every file, by seeking to their bytes."""
    size = 256
    found = B.byte_ranges(spark, vectors_as_files(spark, sf, False), size, ".f32").where((F.col("start") >= 20 * size) & (F.col("start") < 40 * size))

    @F.pandas_udf("double")
    def total(content: pd.Series) -> pd.Series:
        return content.map(lambda b: float(np.frombuffer(b, "<f4").astype(float).sum()))

    file = F.regexp_extract("path", r"(\d+)\.f32$", 1).cast("long")
    return found.select(file.alias("file"), F.expr(f"start div {size}").alias("k"), F.round(total("content"), 4).alias("total"))


@query("S11_headers", """SELECT (vec_id // 100)::BIGINT AS file, 2::BIGINT AS channels, 8000 + (vec_id // 100)::BIGINT AS rate, 16::BIGINT AS bits, (count(*) * 32)::BIGINT AS frames FROM embeddings GROUP BY vec_id // 100""")
def headers(spark, sf):
    found = B.wav_headers(spark, vectors_as_files(spark, sf, True))
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file"), "channels", "rate", "bits", "frames")


@query("K7_S8_archives", """WITH {FR}, v AS (SELECT rec, i - 1 AS row, eid, t FROM fr) SELECT rec, row, eid, round(t, 6) AS t FROM v
UNION ALL SELECT vec_id // 100, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1, vec_id, round(embedding[3]::DOUBLE, 6) FROM embeddings""")
def archives(spark, sf):
    """Frames and vectors as archives of arrays, compressed ones and stored ones, of which two arrays are read back."""
    base = place(spark)
    fr = frames(spark, sf).select("rec", (F.col("i") - 1).alias("row"), "eid", "t", F.coalesce("f", F.lit(float("nan"))).alias("f"), "kind")
    Z.write_archives(fr, "rec", "row", ["eid", "t", "f", "kind"], f"{base}/packed", 50)
    order = F.row_number().over(Window.partitionBy(F.expr("vec_id div 100")).orderBy("vec_id")) - 1
    vectors = table(spark, sf, "embeddings").select(F.expr("vec_id div 100").alias("rec"), order.alias("row"), F.col("vec_id").alias("eid"), "embedding", "label")
    Z.write_archives(vectors, "rec", "row", ["label", "eid", "embedding"], f"{base}/stored", 1_000, compress=False)
    one = Z.read_archives(spark, f"{base}/packed", "eid long, t double")
    two = Z.read_archives(spark, f"{base}/stored", "eid long, embedding array<float>", rows_per_partition=30)
    file = F.regexp_extract("path", r"(\d+)-(\d+)\.npz$", 1).cast("long").alias("rec")
    part = F.regexp_extract("path", r"(\d+)-(\d+)\.npz$", 2).cast("long")
    return one.select(file, (part * 50 + F.col("row")).alias("row"), "eid", r6("t").alias("t")).unionByName(
        two.select(file, "row", "eid", r6(F.col("embedding")[2].cast("double")).alias("t"))
    )
