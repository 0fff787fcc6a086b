"""Scalar text and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc, text as tx
from ..operators import stats
from ..session import table
from .registry import query


@query(
    "boilerplate_stripped",
    r"""WITH t AS (SELECT doc_id, '---' || source || '--- ' || text || chr(10) || '- **a** prose in between **b**' || chr(10) || '-**' || lang || '**' || chr(10) || '- **' || lang || '**:' || chr(10) || '|a|' || chr(10) || '|b| ' || chr(10) || '# x' AS t FROM documents),
s1 AS (SELECT doc_id, regexp_replace(t, '(?s)\A---.*?---\s*', '') AS t FROM t), s2 AS (SELECT doc_id, regexp_replace(t, '(?m)^#{1,6}\s+.*$', '', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(t, '(?m)^\|.*\|$', '', 'g') AS t FROM s2), s4 AS (SELECT doc_id, regexp_replace(t, '(?s)```.*?```', '', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, regexp_replace(t, '(?m)^\s*[-*]\s*\*\*[^*]+\*\*\s*$', '', 'g') AS t FROM s4), s6 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS t FROM s5)
SELECT doc_id, length(t) AS n, md5(t) AS h FROM s6""",
)
def boilerplate_stripped(spark, sf):
    """Texts between front matter and lines that look like boilerplate; some of them are prose and stay."""
    tail = ["\n- **a** prose in between **b**\n-**", "lang", "**\n- **", "lang", "**:\n|a|\n|b| \n# x"]
    text = F.concat(F.lit("---"), "source", F.lit("--- "), "text", *[F.col(x) if x == "lang" else F.lit(x) for x in tail])
    t = tx.strip_boilerplate(text)
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("h"))


@query(
    "phrase_normalized",
    r"""WITH t AS (SELECT p_partkey, lower('[[' || p_name || ']] `' || p_brand || '` *' || p_type || '* [x](y) [x]() `` [[]]') AS t FROM part),
u AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '\[\[([^\]]+)\]\]', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g') AS t FROM t)
SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '[_*#>\-•]+', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM u""",
)
def phrase_normalized(spark, sf):
    p = F.concat(F.lit("[["), "p_name", F.lit("]] `"), "p_brand", F.lit("` *"), "p_type", F.lit("* [x](y) [x]() `` [[]]"))
    return table(spark, sf, "part").select("p_partkey", tx.normalize_phrase(p).alias("phrase"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md, substr(sha256(source || lang), 1, 16) AS pattern_id FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"), tx.short_hash(F.concat("source", "lang")).alias("pattern_id"))


@query(
    "pair_fingerprints",
    "SELECT n_nationkey, substr(sha256(CASE WHEN lower(n_name) = lower(r_name) THEN lower(n_name) WHEN lower(n_name) < lower(r_name) THEN lower(n_name) || '|' || lower(r_name) ELSE lower(r_name) || '|' || lower(n_name) END), 1, 16) AS fp FROM (SELECT n_nationkey, trim(regexp_replace(regexp_replace(n_name, '[_*#>\\-•]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n_name, trim(regexp_replace(regexp_replace(r_name, '[_*#>\\-•]+', ' ', 'g'), '\\s+', ' ', 'g')) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey)",
)
def pair_fingerprints(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", tx.pair_fingerprint(F.col("n_name"), F.col("r_name")).alias("fp"))


@query("alpha_tokens", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_full_match(w, '\p{L}+'))) AS INTEGER) AS n_alpha FROM documents")
def alpha_tokens(spark, sf):
    """Tokens of letters alone; mixed tokens are dropped."""
    return table(spark, sf, "documents").select("doc_id", F.size(tx.alpha_tokens(F.col("text"))).alias("n_alpha"))


@query("line_feeds", "SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS h, len(string_split(text, chr(10))) AS n_lines FROM documents")
def line_feeds(spark, sf):
    t = tx.line_feeds(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("h"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"))


STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(
    "content_words",
    rf"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: regexp_replace(w, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g')), lambda w: w <> '' AND w NOT IN ({STOPS})), ' ') AS words FROM benchmark""",
)
def content_words(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.content_words(F.col("text")), " ").alias("words"))


@query("vocabulary_ids", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM benchmark) SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM t")
def vocabulary_ids(spark, sf):
    """Closed vocabulary of the benchmark: ids by sorted place from 0."""
    t = table(spark, sf, "benchmark").select(F.explode(tx.letter_runs(F.col("text"))).alias("term")).distinct()
    return stats.global_row_number(t, ["term"], "id").select("term", (F.col("id") - 1).cast("long").alias("id"))


@query(
    "token_id_lists",
    "WITH o AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM benchmark), v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM o)) SELECT item_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS multiset, count(DISTINCT id) AS n_distinct FROM o JOIN v ON o.term = v.term GROUP BY 1",
)
def token_id_lists(spark, sf):
    """Sorted token ids per item, repeats kept."""
    o = table(spark, sf, "benchmark").select("item_id", F.explode(tx.letter_runs(F.col("text"))).alias("term"))
    j = o.join(vocabulary_ids(spark, sf), "term").groupBy("item_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return j.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("multiset"), F.size(F.array_distinct("ids")).cast("long").alias("n_distinct"))


@query(
    "char_trigrams",
    "WITH c AS (SELECT string_split(lower(text), '') AS c FROM benchmark), g AS (SELECT unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c) SELECT gram, count(*) AS n FROM g WHERE regexp_full_match(replace(gram, ' ', ''), '\\p{L}+') GROUP BY 1",
)
def char_trigrams(spark, sf):
    """Character 3-grams whose non-space characters are letters: characters as arrays, so no substring scans."""
    chars = F.filter(F.split(F.lower("text"), ""), lambda c: c != "")
    t = table(spark, sf, "benchmark").select(chars.alias("c")).where("size(c) >= 3")
    part = lambda i: F.slice("c", F.lit(i), F.size("c") - 2)
    join = lambda x, y: F.concat(x, y)
    g = t.select(F.explode(F.zip_with(F.zip_with(part(1), part(2), join), part(3), join)).alias("gram"))
    return g.where(F.replace("gram", F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "thinking_stripped",
    r"SELECT page_id, md5(trim(regexp_replace('<think>' || url || '</think>' || html, '(?s)<think>.*?</think>', '', 'g'))) AS h FROM pages",
)
def thinking_stripped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(F.concat(F.lit("<think>"), "url", F.lit("</think>"), "html"), r"(?s)<think>.*?</think>", ""))).alias("h"))


@query("glob_matches", r"SELECT page_id, regexp_matches(url, '^http://[^/]*/en/.*$') AS plain_en, regexp_matches(url, '^https?://.*/[^/]*$') AS has_path FROM pages")
def glob_matches(spark, sf):
    """Path globs as regular expressions."""
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(tx.glob_regex("/http://*/en/**")).alias("plain_en"), F.col("url").rlike("^https?://.*/[^/]*$").alias("has_path"))


@query("surface_ids", "SELECT p_partkey, 'surface::' || replace(trim(regexp_replace(regexp_replace(lower(p_name), '[_*#>\\-•]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '_') AS id, replace(p_brand, '#', '_') AS dotless FROM part")
def surface_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.surface_id(F.col("p_name")).alias("id"), F.translate("p_brand", "#", "_").alias("dotless"))


@query("canonical_ids", "SELECT o_custkey, string_agg(p, '+' ORDER BY p) AS id FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1")
def canonical_ids(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ids"))
    return o.select("o_custkey", tx.canonical_node_id(F.col("ids"), "priority").alias("id"))


@query("synset_parts", "SELECT n_nationkey, 'n' AS pos, lower(n_name) AS lemma FROM nation")
def synset_parts(spark, sf):
    s = F.concat(F.lower("n_name"), F.lit(".n.01"))
    return table(spark, sf, "nation").select("n_nationkey", tx.pos_of_synset(s).alias("pos"), tx.lemma_of_synset(s).alias("lemma"))


@query("triplet_texts", "SELECT o_orderkey, concat_ws(' | ', nullif(o_orderstatus, ''), nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''), CAST(o_custkey AS VARCHAR)) AS t FROM orders")
def triplet_texts(spark, sf):
    p = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", tx.triplet_text(F.col("o_orderstatus"), p, F.col("o_custkey").cast("string")).alias("t"))


@query("previews", "SELECT doc_id, substr(text, 1, 60) AS head FROM documents")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text"), 60).alias("head"))


@query(
    "secret_predicate",
    r"SELECT doc_id, CAST(regexp_matches(text, 'AKIA[0-9A-Z]{16}') AS INTEGER) + CAST(regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{36}') AS INTEGER) + CAST(regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS INTEGER) + CAST(regexp_matches(text, '(?i)(password|secret|token|api_key)\s*[:=]\s*\S{8,}') AS INTEGER) AS n FROM documents",
)
def secret_predicate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.secret_patterns(F.col("text"))).alias("n"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    """Typed parsing of a JSON column; malformed text gives null."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "decay_formulas",
    """SELECT doc_id, round(exp(-0.05 * n_chars / 100.0), 6) AS decay, round(exp(-(n_chars / 100.0) / 3.0), 6) AS retention, round(1 - (1 - 0.6) * pow(0.9, n_chars / 100.0), 6) AS reinforced, round(greatest(0.6 - 0.05 * (n_chars / 1000.0), 0), 6) AS weekly,
round(0.8 * exp(-0.1 * (n_chars / 1000.0)) - 1.5 * 0.01, 6) AS pattern FROM documents""",
)
def decay_formulas(spark, sf):
    n = F.col("n_chars") / 100.0
    return table(spark, sf, "documents").select(
        "doc_id",
        F.round(sc.time_decay(n), 6).alias("decay"),
        F.round(sc.retention(n, F.lit(3.0)), 6).alias("retention"),
        F.round(sc.reinforced(F.lit(0.6), n), 6).alias("reinforced"),
        F.round(sc.weekly_decay(F.lit(0.6), n / 10), 6).alias("weekly"),
        F.round(sc.pattern_confidence(F.lit(0.8), n / 10, F.lit(0.01)), 6).alias("pattern"),
    )


@query(
    "reward_formulas",
    """SELECT l_orderkey, l_linenumber, round(greatest(l_discount - 0.01 * l_linenumber, 0), 6) AS code,
round(CASE WHEN l_quantity < 10 THEN -pow((10 - l_quantity) / 30.0, 2) WHEN l_quantity > 40 THEN -pow((l_quantity - 40) / 30.0, 2) ELSE 1 + 0.5 * (1 - abs(2 * ((l_quantity - 10) / 30.0) - 1)) END, 6) AS band,
round(0.4 * l_discount + 0.3 * l_tax + 0.2 * l_quantity + 0.1, 6) AS fitness, round(2 * l_discount * l_tax / (l_discount + l_tax + 1e-9), 6) AS harmonic,
round(1 / (1 + exp(abs(l_discount * 10))), 6) AS alpha, round(1 / (1 + abs(l_discount * 10)), 6) AS rel FROM lineitem""",
)
def reward_formulas(spark, sf):
    d, q, x = F.col("l_discount"), F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(sc.code_reward(d, F.col("l_linenumber")), 6).alias("code"),
        F.round(sc.band_reward(q, F.lit(10.0), F.lit(40.0)), 6).alias("band"),
        F.round(sc.fitness(d, x, q, F.lit(1.0)), 6).alias("fitness"),
        F.round(sc.harmonic(d, x), 6).alias("harmonic"),
        F.round(sc.ensemble_alpha(d * 10), 6).alias("alpha"),
        F.round(sc.reliability(d * 10), 6).alias("rel"),
    )


@query(
    "inverse_yeo_johnson",
    "SELECT c_custkey, round(CASE WHEN y >= 0 THEN pow(y * 0.5 + 1, 2) - 1 ELSE 1 - pow(1 - 1.5 * y, 1 / 1.5) END, 6) AS half, round(CASE WHEN y >= 0 THEN exp(y) - 1 ELSE 1 - pow(1 - 2 * y, 0.5) END, 6) AS zero, round(CASE WHEN y >= 0 THEN pow(y * 2 + 1, 0.5) - 1 ELSE 1 - exp(-y) END, 6) AS two FROM (SELECT c_custkey, c_acctbal / 2000.0 AS y FROM customer)",
)
def inverse_yeo_johnson(spark, sf):
    y = F.col("c_acctbal") / 2000.0
    return table(spark, sf, "customer").select("c_custkey", *[F.round(sc.inverse_yeo_johnson(y, lam), 6).alias(n) for n, lam in (("half", 0.5), ("zero", 0.0), ("two", 2.0))])


@query("normal_cdf", None)
def normal_cdf(spark, sf):
    """Normal distribution function of standardised balances (tested against the error function)."""
    c = table(spark, sf, "customer")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return c.crossJoin(F.broadcast(m)).select("c_custkey", F.round(sc.normal_cdf((F.col("c_acctbal") - F.col("m")) / F.col("s")), 5).alias("p"))  # one row


@query("floored_scores", "SELECT l.doc_id, CASE WHEN toxic = 0 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 30 THEN CAST(0.15 AS DOUBLE) ELSE CAST(toxic AS DOUBLE) END AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def floored_scores(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return j.select("doc_id", sc.floored_score(F.col("toxic").cast("double"), n).alias("score"))


@query("evidence_confidence", "SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') / 30.4375 < 3 OR o_totalprice < 1000 THEN CAST(0.70 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence FROM orders")
def evidence_confidence(spark, sf):
    o = table(spark, sf, "orders")
    age = F.date_diff(F.to_date(F.lit("1998-08-02")), F.to_date("o_orderdate")) / 30.4375
    return o.select("o_orderkey", sc.evidence_confidence(age, F.when(F.col("o_totalprice") < 1000, 0).otherwise(1)).alias("confidence"))


@query(
    "query_classes",
    r"SELECT item_id, CASE WHEN regexp_matches(lower(text), '\b(when|date|was)\b') THEN 'temporal' WHEN regexp_matches(lower(text), '\b(why|for)\b') THEN 'causal' WHEN regexp_matches(lower(text), '\b(with|and)\b') THEN 'relational' ELSE 'lookup' END AS kind FROM benchmark",
)
def query_classes(spark, sf):
    """Query type by keyword signals, first rule that fits."""
    t = F.lower("text")
    kind = F.when(t.rlike(r"\b(when|date|was)\b"), "temporal").when(t.rlike(r"\b(why|for)\b"), "causal").when(t.rlike(r"\b(with|and)\b"), "relational").otherwise("lookup")
    return table(spark, sf, "benchmark").select("item_id", kind.alias("kind"))


@query("synonym_search", "SELECT page_id, regexp_matches(url, '(utm[ _-]source|page=2|#top)') AS hit FROM pages")
def synonym_search(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(tx.synonym_pattern(["utm source", "page=2", "#top"])).alias("hit"))
