"""Queries over labelled flows, domains, class probabilities, files, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.fixed import FLOW_CSV_COLUMNS, FLOW_CSV_FILES, FLOW_MODEL_FEATURES, MODEL_CLASSES, SECOND_US
from flowloom.functions import text, values
from flowloom.operators import evaluation, labelled, modeling
from flowloom.operators.alerts import ALERT_KEY
from flowloom.operators.flows import FLOW
from flowloom.plans import inputs
from flowloom.plans.catalog import big, prepared, query, r6, raw_labelled, stages
from flowloom.plans.chain import alerts_of_snapshots
from flowloom.plans.oracles import bigram_values, sql
from flowloom.plans.queries_flows import _each
from flowloom.session import checkpoint, shared_dir
from flowloom.sources import captures, tables
from flowloom.streaming import packets as streams
from flowloom.streaming import windows as stream_windows

c = F.col
FEATURES = [f"feature__{n}" for n in FLOW_MODEL_FEATURES]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/flowloom-{name}-{uuid.uuid4().hex}"


# --- scalar functions -----------------------------------------------------------------------------
@query("entropy_from_counts", """select user_id, greatest(0.0, round(-sum(n / t * log2(n / t)), 6)) + 0.0 as entropy from (
  select *, sum(n) over (partition by user_id) as t from (select user_id, event_type, count(*)::double as n from events group by all)) group by user_id""")
def entropy_from_counts(spark, sf):
    counts = inputs.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # One map entry per event type.
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", r6(values.entropy_of_counts(c("m")), "entropy"))


@query("char_entropy", sql("""select page_id, domain, (select greatest(0.0, round(-sum(n / t * log2(n / t)), 6)) + 0.0 from (select count(*)::double as n, sum(count(*)) over () as t
  from (select unnest(string_split(d.domain, '')) as ch) where ch <> '' group by ch)) as entropy from domains d""", "domains"))
def char_entropy(spark, sf):
    return inputs.domains(spark, sf).select("page_id", "domain", r6(text.entropy_of_text(c("domain")), "entropy"))


@query("stable_bucket", """select page_id, domain, (cast('0x' || substr(sha256(domain), 1, 16) as uhugeint) % 8)::bigint as sha2_bucket
  from (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as domain from pages)""")
def stable_bucket(spark, sf):
    return inputs.domains(spark, sf).select("page_id", "domain", big(text.stable_bucket(c("domain"), 8, "sha2"), "sha2_bucket"))


@query("stable_bucket_blake2b")  # DuckDB has no such digest; tested against hashlib
def stable_bucket_blake2b(spark, sf):
    return inputs.domains(spark, sf).select("page_id", "domain", big(text.stable_bucket(c("domain"), 8), "blake2b_bucket"))


@query("periodicity", """with g as (select user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id))::double as gap from events)
select user_id, count(*) as points, round(case when count(*) >= 3 then avg(gap) / 1e6 end, 5) as mean_interval, round(case when count(*) >= 3 then stddev_pop(gap) / avg(gap) end, 6) as cv,
  round(case when count(*) >= 3 then greatest(0.0, least(1.0, 1 - stddev_pop(gap) / avg(gap))) end, 6) as score from g group by user_id""")
def periodicity(spark, sf):
    # Gaps are summed per host; the list form of the same measure is tested against this one.
    e = inputs.table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    # Events of one user are cut by day; the first gap of a day reaches back to the last earlier event.
    from flowloom.operators.scan import chunk_scan

    before = chunk_scan(e, ["user_id"], F.expr("us div 86400000000"), [c("us"), c("event_id")], {"before": ("max", c("us"), False)})
    gap = c("us") - c("before")
    sums = before.groupBy("user_id").agg(
        F.count("*").alias("points"), F.sum(gap).alias("g1"), F.sum((gap.cast("decimal(19,0)") * gap)).alias("g2"))
    p = values.periodicity_from_sums(c("points"), c("g1"), c("g2"))
    return sums.select("user_id", "points", F.round(p["mean_connection_interval"], 5).alias("mean_interval"),
                       r6(p["connection_interval_cv"], "cv"), r6(p["periodicity_score"], "score"))


@query("safe_ratio", "select event_id, case when user_id % 3 > 0 then value / (user_id % 3) end as ratio from events")
def safe_ratio(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", values.safe_ratio(c("value"), c("user_id") % 3).alias("ratio"))


@query("population_variance", """select event_id, case when event_id % 4 = 1 then 0.0 when event_id % 4 > 0 then round(value * value * ((event_id % 4 - 1)::double / (event_id % 4)), 6) end as variance from events""")
def population_variance(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", r6(values.population_variance(c("value"), c("event_id") % 4), "variance"))


@query("pooled_variance", sql("""select source_name, source_row, round(feature__payload_packet_size_variance, 6) as variance from prepared""", "prepared"))
def pooled_variance(spark, sf):
    return prepared(spark, sf).select("source_name", "source_row", r6("feature__payload_packet_size_variance", "variance"))


def _feature_sql(final: str, *needs: str) -> str:
    return sql(final.replace("{rounded}", ", ".join(f"round(feature__{n}, 6) as {n}" for n in FLOW_MODEL_FEATURES)), *needs)


def _rounded() -> list:
    return [r6(f"feature__{n}", n) for n in FLOW_MODEL_FEATURES]


@query("flow_model_features", _feature_sql("select source_name, source_row, {rounded} from prepared", "prepared"))
def flow_model_features(spark, sf):
    return prepared(spark, sf).select("source_name", "source_row", *_rounded())


@query("dns_lexical", sql("""with d as (select distinct domain, string_split(domain, '.') as labels, list_filter(string_split(replace(domain, '.', ''), ''), lambda x: x <> '') as chars from domains)
select domain, len(domain) as domain_length, greatest(len(labels) - 2, 0) as subdomain_count, round(list_sum(list_transform(labels, lambda x: len(x))) / len(labels), 6) as mean_label_length,
  round(len(list_filter(chars, lambda x: regexp_matches(x, '^[0-9]$'))) / len(chars), 6) as digit_ratio, round(len(list_filter(chars, lambda x: regexp_matches(x, '^\\p{L}$'))) / len(chars), 6) as letter_ratio,
  round(len(list_filter(chars, lambda x: x = '-')) / len(chars), 6) as hyphen_ratio,
  round(len(list_filter(chars, lambda x: len(list_filter(chars, lambda y: x = y)) > 1)) / len(chars), 6) as repeated_ratio from d""".replace("with d as", "select * from (with d as") + ")", "domains"))
def dns_lexical(spark, sf):
    d = inputs.domains(spark, sf).select("domain").distinct()
    v = text.dns_lexical(c("domain"))
    return d.select("domain", big(v["domain_length"], "domain_length"), big(v["subdomain_count"], "subdomain_count"), r6(v["mean_label_length"], "mean_label_length"),
                    r6(v["digit_ratio"], "digit_ratio"), r6(v["letter_ratio"], "letter_ratio"), r6(v["hyphen_ratio"], "hyphen_ratio"),
                    r6(v["repeated_character_ratio"], "repeated_ratio"))


@query("dns_query_behaviour", """with e as (select event_id, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
l as (select event_id, list_transform(range(0, user_id % 5 + 1), lambda i: 'h' || cast((k * (i + 1)) % 7 as varchar) || '.example') as recent, 'H' || cast(k % 7 as varchar) || '.EXAMPLE' as domain from e)
select event_id, len(list_filter(recent, lambda x: x = lower(domain))) as frequency, round(len(list_distinct(recent)) / len(recent), 6) as unique_ratio from l""")
def dns_query_behaviour(spark, sf):
    e = inputs.table(spark, sf, "events").selectExpr("event_id", "user_id", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")
    recent = F.transform(F.sequence(F.lit(0), (c("user_id") % 5).cast("int")), lambda i: F.concat(F.lit("h"), ((c("k") * (i + 1)) % 7).cast("string"), F.lit(".example")))
    domain = F.concat(F.lit("H"), (c("k") % 7).cast("string"), F.lit(".EXAMPLE"))
    v = text.dns_query_behaviour(domain, recent)
    return e.select("event_id", big(v["query_frequency"], "frequency"), r6(v["unique_domain_ratio"], "unique_ratio"))


@query("bigram_buckets", """with t as (select * from (values """ + bigram_values() + """) t(pair, bucket)),
d as (select distinct lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as domain from pages),
p as (select domain, substr(domain, i, 2) as pair from (select domain, unnest(range(1, len(domain))) as i from d))
select domain, """ + ", ".join(f"count(*) filter (bucket = {i}) as b{i}" for i in range(8)) + " from p join t using (pair) group by domain")
def bigram_buckets(spark, sf):
    d = inputs.domains(spark, sf).select("domain").distinct().withColumn("b", text.bigram_counts(c("domain")))
    return d.select("domain", *[big(F.get("b", F.lit(i)), f"b{i}") for i in range(8)])


# --- labelled flows -------------------------------------------------------------------------------
@query("normalize_columns", sql("select source_name, source_index, cast(n_out as bigint) as outbound, label from labelled", "labelled"))
def normalize_columns(spark, sf):
    raw = raw_labelled(spark, sf)
    messy = raw.toDF(*[f"  {n.replace(' ', '   ')} " if n in (*FLOW_CSV_COLUMNS, "Label") else n for n in raw.columns])
    return labelled.normalize_columns(messy).select("source_name", "source_index", c("`Total Fwd Packets`").alias("outbound"), c("Label").alias("label"))


@query("map_labels", sql("select raw_label, class as label, count(*) as rows from mapped group by all", "mapped"))
def map_labels(spark, sf):
    return labelled.label_counts(labelled.map_labels(raw_labelled(spark, sf)))


@query("coerce_numeric", sql("""select source_name, source_index, case when source_index % 10 = 0 then null when source_index % 15 = 0 then null when duration_us >= 0 then duration_us::double end as duration,
  (case when source_index % 10 = 0 then 1 when source_index % 15 = 0 then 1 else 0 end)::bigint as nonfinite_cells from labelled""", "labelled"))
def coerce_numeric(spark, sf):
    raw = raw_labelled(spark, sf)
    broken = F.when(c("source_index") % 10 == 0, "n/a").when(c("source_index") % 15 == 0, "Infinity").otherwise(c("`Flow Duration`").cast("string"))
    return labelled.coerce_numeric(raw.withColumn("Flow Duration", broken)).select(
        "source_name", "source_index", c("`Flow Duration`").alias("duration"), big("nonfinite_cells"))


@query("core_valid", sql("select source_name, source_index from valid", "valid"))
def core_valid(spark, sf):
    rows = labelled.map_labels(raw_labelled(spark, sf)).where("label IS NOT NULL")
    return labelled.coerce_numeric(rows).where(labelled.core_valid()).select("source_name", "source_index")


@query("to_shared_features", _feature_sql("select label, count(*) as rows, " + ", ".join(f"round(sum(round(feature__{n}, 6)), 2) as {n}" for n in FLOW_MODEL_FEATURES) + " from prepared group by label", "prepared"))
def to_shared_features(spark, sf):
    return prepared(spark, sf).groupBy("label").agg(
        F.count("*").alias("rows"), *[F.round(F.sum(F.round(f"feature__{n}", 6)), 2).alias(n) for n in FLOW_MODEL_FEATURES])


@query("provenance_blocks", sql("select source_name, source_row, group_id from prepared", "prepared"))
def provenance_blocks(spark, sf):
    return prepared(spark, sf).select("source_name", "source_row", "group_id")


@query("union_sources", sql("select source_name, label, count(*) as rows from prepared group by all", "prepared"))
def union_sources(spark, sf):
    p = prepared(spark, sf)
    parts = [p.where(c("source_name") == f"file{i}.csv") for i in range(3)]
    return labelled.union_sources(parts).groupBy("source_name", "label").agg(F.count("*").alias("rows"))


@query("drop_conflicting", sql("select source_name, source_row, label from conflicts where not clash", "conflicts"))
def drop_conflicting(spark, sf):
    return labelled.drop_conflicting(prepared(spark, sf)).select("source_name", "source_row", "label")


@query("dedupe_exact", sql("select source_name, source_row, label from conflicts where copy = 1", "conflicts"))
def dedupe_exact(spark, sf):
    return labelled.dedupe_exact(prepared(spark, sf)).select("source_name", "source_row", "label")


@query("class_support", sql("select label, count(*) as rows, true as expected from unique_vectors group by label", "unique_vectors"))
def class_support(spark, sf):
    return labelled.class_support(labelled.unique_vectors(prepared(spark, sf)))


@query("preparation_report", sql("""select 'rows_in' as reason, count(*) as rows from mapped union all select 'unsupported_label_rows', count(*) from mapped where class is null
  union all select 'invalid_core_rows_removed', (select count(*) from mapped where class is not null) - (select count(*) from valid) union all select 'nonfinite_numeric_cells', 0
  union all select 'conflicting_rows_removed', count(*) from conflicts where clash union all select 'duplicate_rows_removed', count(*) from conflicts where not clash and copy > 1
  union all select 'rows_kept', count(*) from unique_vectors""", "mapped", "valid", "conflicts", "unique_vectors"))
def preparation_report(spark, sf):
    return labelled.preparation_report(raw_labelled(spark, sf))


def _unique(spark, sf) -> DataFrame:
    return labelled.unique_vectors(prepared(spark, sf))


@query("group_split", sql("select group_id, split from roles", "roles"))
def group_split(spark, sf):
    return labelled.group_roles(_unique(spark, sf)).select("group_id", "split")


@query("first_complete_split", sql("""with g as (select group_id, s as seed, row_number() over (partition by s order by md5(group_id || '|' || cast(s as varchar)), group_id) - 1 as r,
    count(*) over (partition by s) as n from (select distinct group_id from unique_vectors) cross join (select unnest(range(42, 142)) as s)),
b as (select *, (n * 3 + 9) // 10 as held from g), d as (select *, (held * 2 + 2) // 3 as rest from b),
t as (select group_id, seed, case when r < n - held then 'train' when r < n - rest then 'validation' when r < n - (rest + 1) // 2 then 'calibration' else 'test' end as split from d),
x as (select t.split, u.label, count(*) as rows, t.seed from unique_vectors u join t using (group_id) group by all),
f as (select min(seed) as seed from (select seed from x group by seed having count(*) = 4 * (select count(distinct label) from unique_vectors)))
select split, label, rows, cast(seed as bigint) as seed from x join f using (seed)""".replace("with g as", "select * from (with g as") + ")", "unique_vectors"))
def first_complete_split(spark, sf):
    split, seed = labelled.first_complete_split(_unique(spark, sf))
    return split.groupBy("split", "label").agg(F.count("*").alias("rows")).withColumn("seed", F.lit(seed).cast("bigint"))


@query("split_leakage", sql("""select group_id, min(split) as low, max(split) as high from (select group_id, case when source_row % 50 = 0 then 'test' else split end as split
  from unique_vectors join roles using (group_id)) group by group_id having min(split) <> max(split)""", "unique_vectors", "roles"))
def split_leakage(spark, sf):
    # Rows are moved to the test role by row number, so that there is a leak to find.
    split = labelled.group_split(_unique(spark, sf))
    leaky = split.withColumn("split", F.when(c("source_row") % 50 == 0, F.lit("test")).otherwise(c("split")))
    return labelled.split_leakage(leaky)


@query("split_summary", sql("select split, count(*) as rows, count(distinct group_id) as groups, " + ", ".join(
    f"count(*) filter (label = '{n}') as rows_{n}" for n in MODEL_CLASSES) + " from unique_vectors join roles using (group_id) group by split", "unique_vectors", "roles"))
def split_summary(spark, sf):
    return labelled.split_summary(labelled.group_split(_unique(spark, sf)))


# --- evaluation -----------------------------------------------------------------------------------
def _probabilities(spark, sf) -> DataFrame:
    return inputs.class_probabilities(spark, sf).withColumn("probability", F.array("p0", "p1", "p2", "p3"))


def _predicted(spark, sf) -> DataFrame:
    return evaluation.predictions(_probabilities(spark, sf))


COEFFICIENTS = ((1.2, -0.1), (0.9, 0.2), (1.1, 0.05), (0.8, -0.3))
LOGIT = "ln(greatest(1e-7, least(1 - 1e-7, {p})) / (1 - greatest(1e-7, least(1 - 1e-7, {p}))))"
SIGMOID_SQL = "with s as (select *, " + ", ".join(
    f"greatest(1e-12, least(1.0, 1 / (1 + exp(-({a} * {LOGIT.format(p=f'p{i}')} + ({b})))))) as q{i}" for i, (a, b) in enumerate(COEFFICIENTS)) + """ from probs),
t as (select *, q0 + q1 + q2 + q3 as total from s)"""


def _in_with(prefix: str, final: str, *needs: str) -> str:
    """Comparison SQL with its own WITH after the shared blocks."""
    return sql("@@", *needs).replace("\n@@", ",\n" + prefix.removeprefix("with ") + " " + final)


@query("apply_sigmoid", _in_with(SIGMOID_SQL, "select vec_id, " + ", ".join(f"round(q{i} / total, 6) as c{i}" for i in range(4)) + " from t", "probs"))
def apply_sigmoid(spark, sf):
    p = _probabilities(spark, sf).withColumn("cal", evaluation.apply_sigmoid(c("probability"), COEFFICIENTS))
    return p.select("vec_id", *[r6(F.get("cal", F.lit(i)), f"c{i}") for i in range(4)])


@query("score_batch", _in_with(SIGMOID_SQL, """select vec_id, ['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE'][case greatest(q0, q1, q2, q3) when q0 then 1 when q1 then 2 when q2 then 3 else 4 end] as threat_class,
  case greatest(q0, q1, q2, q3) when q0 then p0 when q1 then p1 when q2 then p2 else p3 end as raw_score, round(greatest(q0, q1, q2, q3) / total, 6) as calibrated_confidence from t""", "probs"))
def score_batch(spark, sf):
    p = _probabilities(spark, sf).withColumn("raw", c("probability")).withColumn("calibrated", evaluation.apply_sigmoid(c("probability"), COEFFICIENTS))
    return evaluation.score_batch(p).select("vec_id", "threat_class", "raw_score", r6("calibrated_confidence"))


@query("balanced_weights", sql("""select vec_id, label_idx, round((select count(*) from probs) / ((select count(distinct label_idx) from probs) * count(*) over (partition by label_idx)), 6) as weight from probs""", "probs"))
def balanced_weights(spark, sf):
    return evaluation.balanced_weights(inputs.class_probabilities(spark, sf), "label_idx").select("vec_id", "label_idx", r6("weight"))


@query("class_thresholds", sql("""select ['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE'][k + 1] as class_name, min(score) filter (hits / total >= 0.8) as threshold, max(hits) as support from (
  select k, score, count(*) over w as total, count(*) filter (label_idx = k) over w as hits from (
    select label_idx, 0 as k, p0 as score from probs union all select label_idx, 1, p1 from probs union all select label_idx, 2, p2 from probs union all select label_idx, 3, p3 from probs)
  window w as (partition by k order by score desc range between unbounded preceding and current row)) group by k""", "probs"))
def class_thresholds(spark, sf):
    return evaluation.class_thresholds(_probabilities(spark, sf)).select("class_name", "threshold", big("support"))


REPORT = """with k as (select unnest([0, 1, 2, 3]) as i),
r as (select i, (select count(*) from predicted where label_idx = i) as support, (select count(*) from predicted where predicted_idx = i) as named,
  (select count(*) from predicted where label_idx = i and predicted_idx = i) as hit from k),
m as (select ['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE'][i + 1] as class_name, case when named > 0 then hit / named else 0.0 end as precision,
  case when support > 0 then hit / support else 0.0 end as recall, case when named + support > 0 then 2 * hit / (named + support) else 0.0 end as f1, support from r)"""


@query("classification_report", _in_with(REPORT, """select class_name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from m
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from m""", "predicted"))
def classification_report(spark, sf):
    return evaluation.classification_report(_predicted(spark, sf)).select("class_name", r6("precision"), r6("recall"), r6("f1"), "support")


@query("confusion_matrix", sql("""select ['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE'][a + 1] as label, ['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE'][b + 1] as predicted,
  (select count(*) from predicted where label_idx = a and predicted_idx = b) as rows from (select unnest([0, 1, 2, 3]) as a) cross join (select unnest([0, 1, 2, 3]) as b)""", "predicted"))
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_predicted(spark, sf))


@query("accuracy_brier", sql("""select round(avg((label_idx = predicted_idx)::int), 6) as accuracy,
  round(avg(""" + " + ".join(f"(p{i} - (label_idx = {i})::int) * (p{i} - (label_idx = {i})::int)" for i in range(4)) + "), 6) as brier from predicted", "predicted"))
def accuracy_brier(spark, sf):
    return evaluation.accuracy_and_brier(_predicted(spark, sf)).select(r6("accuracy"), r6("brier"))


BINS = "select least(floor(confidence * 10), 9)::bigint as bin, count(*) as support, avg((label_idx = predicted_idx)::int) as accuracy, avg(confidence) as mean_confidence from predicted group by 1"


@query("reliability_bins", sql(f"select bin, support, round(accuracy, 6) as accuracy, round(mean_confidence, 6) as mean_confidence from ({BINS})", "predicted"))
def reliability_bins(spark, sf):
    return evaluation.reliability_bins(_predicted(spark, sf)).select(big("bin"), "support", r6("accuracy"), r6("mean_confidence"))


@query("calibration_error", sql(f"select round(sum(support * abs(accuracy - mean_confidence)) / sum(support), 6) as calibration_error from ({BINS})", "predicted"))
def calibration_error(spark, sf):
    return evaluation.calibration_error(evaluation.reliability_bins(_predicted(spark, sf))).select(r6("calibration_error"))


# --- models (compared by rows and invariants, not by scores) --------------------------------------
ROUNDTRIP_TREES = 20  # the query is about roles and packages; forest_scores is about the model


def _training(spark, sf) -> tuple[DataFrame, DataFrame]:
    split = checkpoint(labelled.availability_flags(labelled.group_split(_unique(spark, sf))))
    return split.where("split = 'train'"), split.where("split <> 'train'")


def _score_rows(scored: DataFrame) -> DataFrame:
    p = scored.withColumn("label_idx", evaluation.class_index(c("label")))
    return p.select("source_name", "source_row", "label_idx", evaluation.argmax(c("raw")).alias("predicted_idx"),
                    *[F.get("raw", F.lit(i)).alias(f"p{i}") for i in range(len(MODEL_CLASSES))])


@query("forest_scores")
def forest_scores(spark, sf):
    train, rest = _training(spark, sf)
    # Fewer and shallower trees than the defaults, to keep a check run short; the rows are all used.
    return _score_rows(modeling.score_forest(modeling.train_forest(train, MODEL_CLASSES, trees=20, depth=8), rest))


@query("boosted_scores")
def boosted_scores(spark, sf):
    train, rest = _training(spark, sf)
    return _score_rows(modeling.score_boosted(modeling.train_boosted(train, rounds=5, depth=4), rest))


@query("sigmoid_fit")
def sigmoid_fit(spark, sf):
    return modeling.fit_sigmoid(_probabilities(spark, sf), MODEL_CLASSES, probability="probability")


@query("model_roundtrip", sql("""select split as role, count(*) as rows, count(*) as sound, count(*) as same, 4 as thresholds
  from unique_vectors join roles using (group_id) where split <> 'train' group by split""", "unique_vectors", "roles"))
def model_roundtrip(spark, sf):
    """Every role has its own use: trees from train, the sigmoid from calibration, thresholds from validation; test is only scored.

    Scores themselves have no SQL. Per role: rows, rows whose probabilities sum to one, rows on which the loaded package
    scores as the saved one, and the number of thresholds in the package. Conflict removal may leave no row of a class: its score is kept as it is.
    """
    train, rest = _training(spark, sf)
    model = modeling.train_forest(train, MODEL_CLASSES, trees=ROUNDTRIP_TREES)
    scored = checkpoint(modeling.score_forest(model, rest, MODEL_CLASSES).withColumn("label_idx", evaluation.class_index(c("label"))))
    fit = checkpoint(modeling.fit_sigmoid(scored.where("split = 'calibration'"), MODEL_CLASSES, keep_unseen=True))
    own = modeling.coefficient_list(fit)
    calibrated = scored.withColumn("calibrated", evaluation.apply_sigmoid(c("raw"), own))
    reached = evaluation.class_thresholds(calibrated.where("split = 'validation'"), "calibrated").collect()  # one row per class
    thresholds = {r["class_name"]: 1.0 if r["threshold"] is None else r["threshold"] for r in reached}  # none reached: never alert
    path = scratch(spark, "model")
    modeling.save_package(path, model, MODEL_CLASSES, thresholds, fit)
    loaded, classes, limits, coefficients = modeling.load_package(spark, path)
    again = modeling.score_forest(loaded, rest, MODEL_CLASSES).withColumn("again", evaluation.apply_sigmoid(c("raw"), coefficients))
    both = again.select("source_name", "source_row", "again").join(calibrated, ["source_name", "source_row"])
    apart = F.aggregate(F.zip_with("again", "calibrated", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x)
    total = F.aggregate("again", F.lit(0.0), lambda t, x: t + x)
    return both.groupBy(c("split").alias("role")).agg(
        F.count("*").alias("rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("sound"), F.count_if(apart < 1e-12).alias("same"),
        F.lit(len(limits)).alias("thresholds"))


# --- sources and sinks ----------------------------------------------------------------------------
def _write_captures(spark: SparkSession, frames: DataFrame) -> str:
    """Capture files of the derived frames, one per task: test data for the reader."""
    import struct

    folder = scratch(spark, "captures")

    def write(batches):
        out = None
        for batch in batches:
            if out is None:
                filesystem, name = captures.locate(folder)
                filesystem.create_dir(name, recursive=True)
                out = filesystem.open_output_stream(f"{name}/{uuid.uuid4().hex}.pcap")
                out.write(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1))
            for row in batch.to_pylist():
                frame = row["frame"]
                out.write(struct.pack("<IIII", *divmod(row["ts_us"], SECOND_US), len(frame), len(frame)) + frame)
            yield batch.select(["ts_us"])
        if out is not None:
            out.close()

    frames.select("ts_us", "frame").sortWithinPartitions("ts_us").mapInArrow(write, "ts_us long").count()
    return folder


@query("capture_frames", sql("""select ts_us, 14 + case when frame_no % 3 = 0 then 4 else 0 end + 20 + case protocol when 'TCP' then 20 else 8 end
  + coalesce(payload_length, 0) as frame_length, count(*) as frames from packets group by all""", "packets"))
def capture_frames(spark, sf):
    from flowloom.plans.queries_flows import frames

    folder = _write_captures(spark, frames(spark, sf).repartition(4, "frame_no"))
    found, _ = captures.read_captures(spark, folder, span_bytes=1 << 16)
    return found.groupBy("ts_us", F.octet_length("frame").cast("bigint").alias("frame_length")).agg(F.count("*").alias("frames"))


@query("read_labelled_csv", sql("select label, source_name, count(*) as rows, cast(sum(n_out) as bigint) as outbound from labelled group by all", "labelled"))
def read_labelled_csv(spark, sf):
    path = scratch(spark, "labelled") + ".tsv"
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    inputs.labelled_flows(spark, sf).write.options(header="true", sep="\t", **keep).csv(path)
    table = tables.read_labelled(spark, path, "label", "source_name", ["n_out"], schema="n_out long")
    return table.groupBy("label", "source_name").agg(F.count("*").alias("rows"), F.sum("n_out").alias("outbound"))


def _write_exports(spark, sf) -> str:
    """The derived labelled flows as three export files (folders of parts) under the required names."""
    folder = scratch(spark, "exports")
    raw = raw_labelled(spark, sf)
    for i, name in enumerate(FLOW_CSV_FILES):
        part = raw.where(c("source_name") == f"file{i}.csv").drop("source_name")
        part.select(*[c(f"`{n}`").alias(f" {n}") for n in FLOW_CSV_COLUMNS], "Label", "source_index").coalesce(1).sortWithinPartitions(
            "source_index").write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/{name}")
    return folder


@query("flow_csv_scan", sql("""select source_index, n_out::double as outbound, case source_name when 'file0.csv' then 0 when 'file1.csv' then 1 else 2 end as file, trim(label) as label from labelled""", "labelled"))
def flow_csv_scan(spark, sf):
    folder = _write_exports(spark, sf)
    scan = tables.read_flow_csvs(spark, folder)
    position = F.when(c("export") == FLOW_CSV_FILES[0], 0).when(c("export") == FLOW_CSV_FILES[1], 1).otherwise(2)
    return labelled.map_labels(scan).select("source_index", c("`Total Fwd Packets`").cast("double").alias("outbound"),
                                            position.alias("file"), c("raw_label").alias("label"))


@query("feature_table_roundtrip", _feature_sql("select source_name, source_row, split, {rounded} from unique_vectors join roles using (group_id)", "unique_vectors", "roles"))
def feature_table_roundtrip(spark, sf):
    path = scratch(spark, "features")
    tables.write_feature_table(labelled.group_split(_unique(spark, sf)), path)
    return tables.read_feature_table(spark, path).select("source_name", "source_row", "split", *_rounded())


@query("source_manifest")
def source_manifest(spark, sf):
    return tables.source_manifest(spark, f"{sf}/*.parquet")


@query("alert_append", sql("select decision, threat_class, 2 * count(*) as rows from kept_alerts group by all", "kept_alerts"))
def alert_append(spark, sf):
    path = scratch(spark, "alerts")
    kept = stages(spark, sf).kept_alerts
    tables.append_alerts(kept, path)
    tables.append_alerts(kept, path)
    return spark.read.parquet(path).groupBy("decision", "threat_class").agg(F.count("*").alias("rows"))


# --- streams, drained and compared with the batch meaning -----------------------------------------
SLICES, FILES_PER_SLICE = 3, 4


def _sliced(spark, rows: DataFrame, name: str, *keys: str, at: str = "ts_us") -> str:
    """Rows written as time slices, so that a stream takes them in order, and a closing marker after them."""
    path = scratch(spark, name)
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    step = (span["hi"] - span["lo"]) // SLICES + 1
    for i in range(SLICES):
        slice_rows = rows.where(((c(at) - span["lo"]) / step).cast("int") == i)
        slice_rows.repartition(FILES_PER_SLICE, *keys).write.mode("append").parquet(path)
    streams.closing_marker(rows, at).coalesce(1).write.mode("append").parquet(path)
    return path


def _packet_folder(spark, sf) -> tuple[str, DataFrame]:
    ordered = checkpoint(stages(spark, sf).ordered.select("capture_id", "flow_key", "frame_no", "ts_us", "src_ip", "direction", "packet_length"))
    return _sliced(spark, ordered, "packets", "flow_key"), ordered


@query("stream_late", sql("select frame_no, ts_us, late from marked", "marked"))
def stream_late(spark, sf):
    """Packets in frame order, in slices that a stream takes one by one; a capture's part of a slice is one file."""
    from flowloom.operators.packets import known_protocols

    rows = known_protocols(inputs.packets(spark, sf)).select("capture_id", "frame_no", "ts_us")
    path, out = scratch(spark, "arrivals"), scratch(spark, "late")
    span = rows.agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi")).first()
    step = (span["hi"] - span["lo"]) // SLICES + 1
    for i in range(SLICES):
        part = rows.where(((c("frame_no") - span["lo"]) / step).cast("int") == i)
        part.repartition(FILES_PER_SLICE, "capture_id").write.mode("append").parquet(path)
    with streams.rocksdb(spark):
        streams.drain(streams.mark_late(streams.packet_stream(spark, path, rows.schema, 1)), out, out + "-log")
    return spark.read.parquet(out).select("frame_no", "ts_us", "late")


@query("stream_rates", sql("""select capture_id, ts_us // 1000000 * 1000000 as interval_us, count(*) as packets, cast(sum(packet_length) as bigint) as bytes from keyed group by all""", "keyed"))
def stream_rates(spark, sf):
    path, ordered = _packet_folder(spark, sf)
    out = scratch(spark, "rates")
    source = streams.packet_stream(spark, path, ordered.schema, FILES_PER_SLICE)
    streams.drain(streams.rates(source), out, out + "-log")
    return spark.read.parquet(out)


@query("stream_flows", sql("""select f.flow_start, f.start_us, f.last_seen_us, f.packets_a_to_b, f.packets_b_to_a, f.bytes_a_to_b + f.bytes_b_to_a as bytes,
  case when lead(f.flow_start) over (partition by f.capture_id, f.session_start order by f.flow_start) is not null then 'active' else 'idle' end as reason
  from flows f""", "flows"))
def stream_flows(spark, sf):
    path, ordered = _packet_folder(spark, sf)
    out = scratch(spark, "flows")
    source = streams.packet_stream(spark, path, ordered.schema, FILES_PER_SLICE)
    with streams.rocksdb(spark):
        streams.drain(streams.stateful_flows(source), out, out + "-log")
    return spark.read.parquet(out).drop("capture_id", "flow_key")


@query("stream_alerts", sql("select alert_id, flow_id, threat_class, decision from kept_alerts", "kept_alerts"))
def stream_alerts(spark, sf):
    alerts = stages(spark, sf).alerts.select(*ALERT_KEY, "ts_us", "flow_id", "alert_id")
    path = _sliced(spark, alerts, "alerts", *ALERT_KEY)
    out = scratch(spark, "kept")
    source = streams.packet_stream(spark, path, alerts.schema, FILES_PER_SLICE)
    with streams.rocksdb(spark):
        streams.drain(streams.suppress_alerts(source), out, out + "-log")
    return spark.read.parquet(out).select("alert_id", "flow_id", "threat_class", "decision")


@query("stream_host_counts", sql("""select src_ip, w * 1000000 as window_end_us, count(*) as packets, cast(sum(packet_length) as bigint) as bytes from (
  select src_ip, packet_length, unnest(range(ts_us // 1000000 + 1, ts_us // 1000000 + 61)) as w from keyed) group by all""", "keyed"))
def stream_host_counts(spark, sf):
    path, ordered = _packet_folder(spark, sf)
    out = scratch(spark, "hosts")
    source = streams.packet_stream(spark, path, ordered.schema, FILES_PER_SLICE)
    streams.drain(streams.host_counts(source), out, out + "-log")
    return spark.read.parquet(out).select("src_ip", "window_end_us", "packets", "bytes")


def _windows_of_stream(spark, sf, host: str, sums: dict, distinct: dict) -> DataFrame:
    rows = stages(spark, sf).flow_packets.select(
        "capture_id", "frame_no", "ts_us", "src_ip", "dst_ip", "dst_port", "protocol", "packet_length", "is_new")
    path, out = _sliced(spark, rows, "window-packets", host), scratch(spark, "windows")
    source = streams.packet_stream(spark, path, rows.schema, FILES_PER_SLICE)
    with streams.rocksdb(spark):
        streams.drain(stream_windows.host_windows(source, host, sums, distinct), out, out + "-log")
    return spark.read.parquet(out).select("frame_no", *sums, *distinct)


@query("stream_source_windows", _each("""count(*) as packets, cast(sum(e.packet_length) as bigint) as bytes, count(*) filter (e.is_new) as new_flows,
  count(distinct e.dst_ip) as destinations, count(distinct e.dst_port) as ports""", "e.src_ip = p.src_ip"))
def stream_source_windows(spark, sf):
    return _windows_of_stream(spark, sf, "src_ip", {"packets": F.lit(1), "bytes": c("packet_length"), "new_flows": c("is_new").cast("int")},
                              {"destinations": c("dst_ip"), "ports": c("dst_port")})


@query("stream_target_windows", _each("""count(*) as packets, count(*) filter (e.protocol = 'UDP') as udp_packets, count(distinct e.src_ip) as sources""", "e.dst_ip = p.dst_ip"))
def stream_target_windows(spark, sf):
    return _windows_of_stream(spark, sf, "dst_ip", {"packets": F.lit(1), "udp_packets": (c("protocol") == "UDP").cast("int")}, {"sources": c("src_ip")})


@query("stream_scores", sql("select alert_id, flow_id, threat_class, decision from kept_alerts", "kept_alerts"))
def stream_scores(spark, sf):
    """Snapshots as a stream: features, scores, gate and alerts by micro-batch, written once; a second stream suppresses them."""
    rows = checkpoint(stages(spark, sf).snapshot_rows)
    path, scored, out = _sliced(spark, rows, "snapshots", *FLOW, at="last_seen_us"), scratch(spark, "scored"), scratch(spark, "kept-scores")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_SLICE).parquet(path)
    # All alerts of a key that a micro-batch brings are one file, so the next stream takes them in order.
    by_key = lambda batch: alerts_of_snapshots(batch).select(*ALERT_KEY, "ts_us", "flow_id", "alert_id").repartition(FILES_PER_SLICE, *ALERT_KEY)
    streams.score_batches(source, by_key, scored, scored + "-log").awaitTermination()
    schema = spark.read.parquet(f"{scored}/batch=0").schema
    alerts = streams.packet_stream(spark, f"{scored}/batch=*", schema, FILES_PER_SLICE)
    with streams.rocksdb(spark):
        streams.drain(streams.suppress_alerts(alerts), out, out + "-log")
    return spark.read.parquet(out).select("alert_id", "flow_id", "threat_class", "decision")
