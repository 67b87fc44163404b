"""Token arrays: filters over sequences, statistics, objectives, shifts and boundaries."""

from __future__ import annotations


from pyspark.sql import functions as F

from rollsift.functions import arrays as ar
from rollsift.functions import scalars as sc
from rollsift.operators import filters as fl
from rollsift.operators import losses as ls
from rollsift.operators import metrics as m
from rollsift.operators.batches import bucket_of
from rollsift.operators.ordering import top_experts
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, SEQUENCES, read, rollouts, sequences, tidy

# log probabilities of a line: minus its discount (percent) over ten
_LP = "(-d / 10.0)"
# one trainable token in three, and both signs of advantages
_MASK, _ADV = "(q % 3 <> 0)", "((t - 4) / 2.0)"


def _tokens(spark, sf_dir):
    xs = F.col("xs")
    return sequences(spark, sf_dir).select(
        "id", F.transform(xs, lambda x: x["token"]).alias("ids"), F.transform(xs, lambda x: -x["d"] / 10.0).alias("lp"), F.transform(xs, lambda x: -x["t"] / 10.0).alias("ip"),
        F.transform(xs, lambda x: x["q"] % 3 != 0).alias("mask"), F.transform(xs, lambda x: (x["t"] - 4) / 2.0).alias("adv"), F.transform(xs, lambda x: x["flag"]).alias("env"),
        F.transform(xs, lambda x: x["q"]).alias("q"),
    )


@query(f"""WITH {SEQUENCES} SELECT id, min(pos - 1) FILTER (token > 1000 AND {_LP} < -ln(2) - 0.1) AS gibberish_at FROM places GROUP BY id""")
def o9_gibberish(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", fl.gibberish_index(F.array("ids"), F.array("lp"), 2, 1000, 0.1).alias("gibberish_at"))


@query(f"""WITH {SEQUENCES}, b AS (SELECT *, sum((NOT {_LP} > ln(0.8))::INT) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island, {_LP} > ln(0.8) AS likely FROM places),
    r AS (SELECT id, pos, likely, sum(likely::INT) OVER (PARTITION BY id, island ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT id, min(pos - 1) FILTER (likely AND run >= 2) AS repetition_at FROM r GROUP BY id""")
def o10_repetition(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", fl.repetition_index(F.array("lp"), 2, 0.8).alias("repetition_at"))


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, CASE WHEN cents % 2 = 1 THEN 'prompt mask length' WHEN cents % 3 = 1 THEN 'completion logprobs length' WHEN len % 10 + 5 > 12 THEN 'sample too long' END AS problem FROM rollouts""")
def o12_sample_problems(spark, sf_dir):
    n, c = (F.col("len") % 10).cast("int"), F.col("cents")
    of = lambda size, x: F.array_repeat(x, size)
    df = rollouts(spark, sf_dir).select(
        "rollout_id", of(n, F.lit(1)).alias("prompt_ids"), of(n + (c % 2).cast("int"), F.lit(True)).alias("prompt_mask"), of(F.lit(5), F.lit(2)).alias("completion_ids"),
        of(F.lit(5), F.lit(True)).alias("completion_mask"), of(F.when(c % 3 == 1, 4).otherwise(5), F.lit(0.0)).alias("completion_logprobs"),
        of(F.lit(5), F.lit(1.0)).alias("completion_temperatures"), F.lit(None).cast("array<double>").alias("teacher_logprobs"),
    )
    return df.select("rollout_id", fl.sample_problem(12).alias("problem"))


@query(f"WITH {SEQUENCES} SELECT id, bool_or({_MASK} AND pos <= 2) AS trainable FROM places GROUP BY id")
def o15_trainable(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", fl.has_trainable("mask", 2).alias("trainable"))


@query(f"WITH {SEQUENCES} SELECT id, coalesce(max(pos) FILTER (NOT (NOT {_MASK} AND flag = 'R')), 0)::INT AS kept FROM places GROUP BY id")
def o16_trim_padding(spark, sf_dir):
    pairs = F.arrays_zip(F.col("mask").alias("m"), F.col("env").alias("e"))
    return _tokens(spark, sf_dir).select("id", ar.trim_trailing(pairs, lambda x, _: ~x["m"] & (x["e"] == "R")).alias("kept"))


@query(f"""WITH {ROLLOUTS}, k AS (SELECT rollout_id, env_name || '/' || kind || CASE WHEN cents % 2 = 0 THEN '/mean' ELSE '/max' END AS key FROM rollouts)
    SELECT rollout_id FROM k WHERE (NOT starts_with(key, 'env1/') AND NOT ends_with(key, '/max')) OR starts_with(key, 'env1/view')""")
def o17_metric_keys(spark, sf_dir):
    df = rollouts(spark, sf_dir).withColumn("key", F.concat_ws("/", "env_name", "kind", F.when(F.col("cents") % 2 == 0, "mean").otherwise("max")))
    return df.where(fl.metric_key_allowed("key", ["env1/view"], ["env1/"], ["/max"])).select("rollout_id")


@query(f"WITH {SEQUENCES} SELECT id, count(*) FILTER (d > 0) AS kept FROM places GROUP BY id")
def o19_drop_non_finite(spark, sf_dir):
    broken = F.transform("xs", lambda x: F.when(x["d"] > 0, x["d"].cast("double")).when(x["q"] % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    return sequences(spark, sf_dir).select("id", F.size(ar.drop_non_finite(broken)).cast("long").alias("kept"))


@query(f"WITH {SEQUENCES} SELECT id, count(*) FILTER ({_MASK}) AS decode_tokens, count(*) FILTER (NOT {_MASK}) + count(*) AS prefill_tokens FROM places GROUP BY id")
def a14_prefill_decode(spark, sf_dir):
    return m.prefill_decode(_tokens(spark, sf_dir).withColumn("prompt_ids", F.col("ids")), mask="mask", completion="ids").select("id", "decode_tokens", "prefill_tokens")


@query(f"""WITH {SEQUENCES}, s AS (SELECT id % 10 AS part, q::DOUBLE AS q, d::DOUBLE AS d, {_MASK} AS m FROM places)
    SELECT part, avg(q) FILTER (m) AS q_mean, max(q) FILTER (m) AS q_max, avg(d) FILTER (m) AS d_mean, max(d) FILTER (m) AS d_max FROM s GROUP BY part""")
def a21_token_statistics(spark, sf_dir):
    df = sequences(spark, sf_dir).select((F.col("id") % 10).alias("part"), F.transform("xs", lambda x: x["q"].cast("double")).alias("q"), F.transform("xs", lambda x: x["d"].cast("double")).alias("d"), F.transform("xs", lambda x: x["q"] % 3 != 0).alias("loss_mask"))
    return m.token_statistics(df, ["q", "d"], keys=["part"])


@query(f"""WITH {SEQUENCES}, s AS (SELECT 'all' AS scope, q, d FROM places WHERE {_MASK} UNION ALL SELECT flag, q, d FROM places WHERE {_MASK}) SELECT scope, avg(q) AS q, avg(d) AS d FROM s GROUP BY scope""")
def a23_token_means_by_environment(spark, sf_dir):
    df = sequences(spark, sf_dir).select(F.transform("xs", lambda x: x["q"]).alias("q"), F.transform("xs", lambda x: x["d"]).alias("d"), F.transform("xs", lambda x: x["flag"]).alias("env_names"), F.transform("xs", lambda x: x["q"] % 3 != 0).alias("loss_mask"))
    return m.token_means_by_environment(df, ["q", "d"])


@query(f"WITH {SEQUENCES} SELECT flag, avg(q) / avg(d) AS kl_ent_ratio FROM places GROUP BY flag")
def a24_kl_entropy_ratio(spark, sf_dir):
    items = sequences(spark, sf_dir).select(F.explode("xs").alias("x"))
    return items.groupBy(F.col("x.flag").alias("flag")).agg(m.kl_entropy_ratio(F.col("x.q"), F.col("x.d")).alias("kl_ent_ratio"))


@query(f"WITH {SEQUENCES} SELECT id, coalesce(sum(q) FILTER ({_MASK}), 0) / greatest(count(*) FILTER ({_MASK}), 1) AS masked_mean FROM places GROUP BY id")
def a25_masked_mean(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", ar.masked_mean("q", "mask").alias("masked_mean"))


@query(f"WITH {SEQUENCES} SELECT id % 10 AS part, greatest(count(*) FILTER ({_MASK}), 1) AS scale FROM places GROUP BY part")
def a26_loss_scale(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy((F.col("id") % 10).alias("part")).agg(ls.loss_scale(F.col("mask")).cast("long").alias("scale"))


def _toks():
    return ls.tokens("lp", "ip", "adv", "mask")


_T, _I = _LP, "(-t / 10.0)"
_DROP = f"CASE WHEN {_ADV} > 0 THEN exp({_T}) - exp({_I}) > 0.2 ELSE exp({_T}) - exp({_I}) < -0.2 END"
_KL = f"CASE WHEN {_MASK} THEN 0.001 * ({_T} - {_I}) * ({_T} - {_I}) ELSE 0 END"


@query(f"WITH {SEQUENCES} SELECT id, round(sum({_KL} - CASE WHEN {_MASK} AND NOT ({_DROP}) THEN {_ADV} * exp({_T} - {_I}) ELSE 0 END), 6) + 0 AS loss FROM places GROUP BY id")
def l2_policy_loss(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", tidy(ls.policy_loss(_toks()), 6).alias("loss"))


@query(f"WITH {SEQUENCES} SELECT id, round(sum({_KL} - CASE WHEN {_MASK} AND abs(exp({_T}) - exp({_I})) <= 0.1 THEN {_ADV} * exp({_T} - {_I}) ELSE 0 END), 6) + 0 AS loss FROM places GROUP BY id")
def l3_ipo_loss(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", tidy(ls.ipo_loss(_toks()), 6).alias("loss"))


@query(f"WITH {SEQUENCES} SELECT id, round(sum({_KL} - CASE WHEN {_MASK} AND NOT ({_DROP}) THEN (-q / 50.0 - {_T}) * exp({_T} - {_I}) ELSE 0 END), 6) + 0 AS loss FROM places GROUP BY id")
def l4_distillation_loss(spark, sf_dir):
    df = _tokens(spark, sf_dir).withColumn("teacher", F.transform("q", lambda q: -q / 50.0))
    return df.select("id", tidy(ls.distillation_loss(ls.tokens("lp", "ip", "adv", "mask", "teacher")), 6).alias("loss"))


@query(f"WITH {SEQUENCES} SELECT id, round(coalesce(sum(-{_T}) FILTER ({_MASK}), 0), 6) + 0 AS loss FROM places GROUP BY id")
def l5_sft_loss(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", tidy(ls.sft_loss(_toks()), 6).alias("loss"))


@query(f"""WITH {SEQUENCES} SELECT id, round(CASE WHEN id % 2 = 0 THEN sum({_KL} - CASE WHEN {_MASK} AND NOT ({_DROP}) THEN {_ADV} * exp({_T} - {_I}) ELSE 0 END)
    ELSE coalesce(sum(-{_T}) FILTER ({_MASK}), 0) END / 8, 9) + 0 AS loss FROM places GROUP BY id""")
def l6_dispatched_loss(spark, sf_dir):
    mode = F.when(F.col("id") % 2 == 0, "rl").otherwise("sft")
    return _tokens(spark, sf_dir).select("id", tidy(ls.loss(_toks(), mode, F.lit(8.0)), 9).alias("loss"))


@query(f"""WITH {SEQUENCES} SELECT id, round(sum(exp({_T} - {_I}) - ({_T} - {_I}) - 1), 6) + 0 AS mismatch_kl, count(*) FILTER ({_MASK} AND {_ADV} > 0 AND exp({_T}) - exp({_I}) > 0.2) AS high,
    count(*) FILTER ({_MASK} AND {_ADV} < 0 AND exp({_T}) - exp({_I}) < -0.2) AS low, count(*) FILTER ({_MASK} AND ({_DROP})) AS masked FROM places GROUP BY id""")
def l7_export_columns(spark, sf_dir):
    df = _tokens(spark, sf_dir).withColumn("e", ls.export_columns(_toks(), F.lit("rl")))
    count = lambda f: F.size(F.filter("e", lambda x: x[f])).cast("long")
    kl = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["mismatch_kl"])
    return df.select("id", tidy(kl, 6).alias("mismatch_kl"), count("is_masked_high").alias("high"), count("is_masked_low").alias("low"), count("is_masked").alias("masked"))


@query(f"""WITH {SEQUENCES}, s AS (SELECT id, pos, coalesce(lead(q) OVER w, 0) AS l, coalesce(lag(q) OVER w, -1) AS r FROM places WINDOW w AS (PARTITION BY id ORDER BY pos))
    SELECT id, string_agg(l::VARCHAR, ',' ORDER BY pos) AS left_shifted, string_agg(r::VARCHAR, ',' ORDER BY pos) AS right_shifted FROM s GROUP BY id""")
def w7_shifts(spark, sf_dir):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _tokens(spark, sf_dir).select("id", text(ar.shift_left("q", F.lit(0).cast("long"))).alias("left_shifted"), text(ar.shift_right("q", F.lit(-1).cast("long"))).alias("right_shifted"))


@query(f"""WITH {SEQUENCES}, b AS (SELECT id, pos - 1 AS start, size FROM places WHERE pos = 1 OR q % 4 = 0), n AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY id ORDER BY start), size) AS stop FROM b)
    SELECT id, string_agg(start::VARCHAR, ',' ORDER BY start) || ',' || any_value(size) AS bounds, max(stop - start)::INT AS longest FROM n GROUP BY id""")
def w8_sequence_boundaries(spark, sf_dir):
    places = F.transform("q", lambda q: q % 4)
    df = _tokens(spark, sf_dir)
    return df.select("id", F.array_join(F.transform(ar.sequence_boundaries(places), lambda x: x.cast("string")), ",").alias("bounds"), ar.longest_sequence(places).cast("int").alias("longest"))


@query(f"""WITH {SEQUENCES}, e AS (SELECT id, token, pos FROM places UNION ALL SELECT id, 7, size + 1 FROM places WHERE pos = size AND token <> 7), z AS (SELECT *, max(pos) OVER (PARTITION BY id) AS n FROM e)
    SELECT id, coalesce(sum(token) FILTER (pos < n), 0)::BIGINT AS inputs, coalesce(sum(token) FILTER (pos > 1), 0)::BIGINT AS targets, (max(n) - 1)::INT AS n FROM z GROUP BY id""")
def m9_next_token_shift(spark, sf_dir):
    ids = ar.append_if_missing("ids", F.lit(7).cast("long"))
    df = _tokens(spark, sf_dir).withColumn("s", ar.next_token_shift(ids, F.transform(ids, lambda _: F.lit(True))))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("id", total("s.input_ids").alias("inputs"), total("s.target_ids").alias("targets"), F.size("s.position_ids").alias("n"))


@query(f"WITH {SEQUENCES} SELECT id, CASE WHEN max(size) <= 2 THEN 256 WHEN max(size) <= 4 THEN 512 ELSE 1024 END AS bucket, (max(size) * 3 + sum(q) * 0)::DOUBLE AS cost FROM places GROUP BY id")
def p12_bucket(spark, sf_dir):
    n = F.size("ids")
    return _tokens(spark, sf_dir).select("id", bucket_of(n * 128, 1024).alias("bucket"), ar.bin_cost(F.array_repeat(F.lit(1), n), 2.0, 1.0).alias("cost"))


@query(f"""WITH {SEQUENCES} SELECT id, sum(CASE WHEN token % 5 = 0 THEN 2 WHEN token % 7 = 0 THEN 1 ELSE 0 END)::INT AS types FROM places GROUP BY id""")
def j11_modality_types(spark, sf_dir):
    known = F.expr("map_from_entries(transform(sequence(0, 34), i -> struct(i, case when i % 5 = 0 then 2 when i % 7 = 0 then 1 else 0 end)))")
    few = F.map_filter(known, lambda _, v: v > 0)
    types = ar.modality_types(F.transform("ids", lambda t: (t % 35).cast("int")), few)
    return _tokens(spark, sf_dir).select("id", F.aggregate(types, F.lit(0), lambda a, x: a + x).alias("types"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM v)
    SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY r) AS experts FROM r WHERE r <= 4 GROUP BY vec_id""")
def t10_top_experts(spark, sf_dir):
    top = top_experts(F.transform("embedding", lambda x: x.cast("double")), 4)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda i: i.cast("string")), ",").alias("experts"))


@query("""SELECT doc_id, left(sha256(text), 16) AS hash, CASE WHEN n_chars < 1000 THEN printf('%.2f', n_chars::DOUBLE) ELSE printf('%.2f', floor(n_chars / 10.0 + 0.5) / 100) || 'K' END AS short,
    CASE WHEN n_chars >= 86400 THEN (n_chars // 86400) || 'd ' || (n_chars // 3600 % 24) || 'h' WHEN n_chars >= 3600 THEN (n_chars // 3600) || 'h ' || (n_chars // 60 % 60) || 'm' WHEN n_chars >= 60 THEN (n_chars // 60) || 'm ' || (n_chars % 60) || 's' WHEN n_chars >= 1 THEN printf('%.2fs', n_chars::DOUBLE) WHEN n_chars IS NOT NULL THEN printf('%.0fms', n_chars * 1000.0) END AS duration,
    CASE WHEN starts_with(source, 'src1') THEN source[5:] ELSE source END AS cut FROM documents""")
def s8_text_functions(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", sc.content_hash("text").alias("hash"), sc.format_number("n_chars").alias("short"), sc.format_seconds("n_chars").alias("duration"), sc.remove_prefix("source", "src1").alias("cut"))


@query("""SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped, upper(left(role, 1)) || substr(role, 2) AS role_name, sha256(role || '|' || turn) AS key FROM conversations""")
def s8_message_functions(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", sc.strip_content("text").alias("stripped"), sc.capitalise("role").alias("role_name"), F.sha2(sc.composite_key("role", "turn"), 256).alias("key"))


@query(f"WITH {SEQUENCES} SELECT id, round(CASE WHEN count(*) % 4 = 0 THEN 0 ELSE 1.0 END, 3) + 0 AS padded FROM places GROUP BY id")
def p7_needs_padding(spark, sf_dir):
    wide = ar.pad_to_multiple("ids", 4, F.lit(1).cast("long"))
    return _tokens(spark, sf_dir).select("id", (F.size(wide) != F.size("ids")).cast("double").alias("padded"))


