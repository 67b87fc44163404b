"""Queries of operators on rows, maps, text and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollsift.functions import arrays as ar
from rollsift.functions import scalars as sc
from rollsift.operators import batches as bt
from rollsift.operators import filters as fl
from rollsift.operators import messages as ms
from rollsift.operators import metrics as m
from rollsift.operators import ordering as od
from rollsift.operators import relations as rl
from rollsift.operators import sampling as sp
from rollsift.operators import trajectories as tj
from rollsift.operators.advantage import custom_advantage
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, SEQUENCES, read, rollouts, sequences, tidy
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr
from rollsift.streaming.groups import lead_gate, sink


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, CASE WHEN error IS NULL AND cents % 3 = 0 THEN 'EmptyTrajectory' ELSE error END AS error FROM rollouts""")
def o14_promoted(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("trajectory", F.when(F.col("cents") % 6 == 0, F.array().cast("array<int>")).when(F.col("cents") % 3 != 0, F.array(F.lit(1))))
    return fl.promote_empty(r).select("rollout_id", "error")


@query("""SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY substr(md5('0:' || o_orderkey), 1, 15)) <= (SELECT greatest(1, floor(count(*) * 0.3))::BIGINT FROM orders)""")
def o18_exact_sample(spark, sf_dir):
    return fl.exact_sample(read(spark, sf_dir, "orders"), 0.3, "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, kind AS env_name, cents AS reward, is_truncated AS filters FROM rollouts""")
def o24_io_rows(spark, sf_dir):
    r = rollouts(spark, sf_dir).select(F.struct("rollout_id", F.lit("raw").alias("env_name"), "reward").alias("raw"), F.col("kind").alias("env_name"), F.col("cents").alias("reward"), F.col("is_truncated").alias("filter_results"), F.lit(1).alias("samples"))
    return fl.io_row(r, "raw")


@query("SELECT l_orderkey AS id, (3 * count(*))::INT AS tokens FROM lineitem GROUP BY 1")
def a5_completion_length(spark, sf_dir):
    steps = sequences(spark, sf_dir).withColumn("steps", F.transform("xs", lambda x: F.struct(F.array(x["token"], x["supp"], x["q"]).alias("completion_ids"))))
    steps = steps.withColumn("steps", F.concat("steps", F.array(F.struct(F.lit(None).cast("array<bigint>").alias("completion_ids")))))
    return steps.select("id", m.completion_length("steps").alias("tokens"))


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, CASE WHEN cents % 2 = 0 THEN reward ELSE len::DOUBLE END AS value FROM rollouts""")
def a6_suffix_value(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    own = F.when(F.col("cents") % 2 == 0, F.lit("env/a_reward")).otherwise(F.lit("env/reward_other"))
    return r.select("rollout_id", sc.suffix_value(F.create_map(own, F.col("reward"), F.lit("x_reward"), F.col("len").cast("double")), "_reward").alias("value"))


@query("SELECT l_orderkey AS id, least(count(*), 2)::INT AS prompt_tokens, greatest(count(*) - 2, 0)::INT AS completion_tokens, count(*)::INT AS total_tokens FROM lineitem GROUP BY 1")
def a39_usage(spark, sf_dir):
    s = sequences(spark, sf_dir)
    used = m.usage(F.slice("xs", F.lit(1), F.lit(2)), F.slice("xs", F.lit(3), F.greatest(F.size("xs") - 2, F.lit(0))))
    return s.select("id", used.alias("u")).select("id", "u.*")


@query(f"""WITH {ROLLOUTS} SELECT count(*)::BIGINT AS seen, round(avg((cents % 7 = 0 OR cents % 4 = 1)::INT), 9) + 0 AS dropped_rate, round(avg((cents % 7 = 0)::INT), 9) + 0 AS long_rate, round(avg((cents % 4 = 1)::INT), 9) + 0 AS stopped_rate FROM rollouts""")
def a11_pre_filter_rates(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("filter_results", F.create_map(F.lit("long"), F.col("cents") % 7 == 0, F.lit("stopped"), F.col("cents") % 4 == 1))
    r = r.withColumn("is_filtered", F.exists(F.map_values("filter_results"), lambda x: x))
    return m.pre_filter_rates(r, ["long", "stopped"]).select("seen", *[tidy(c, 9).alias(c) for c in ("dropped_rate", "long_rate", "stopped_rate")])


@query(f"""WITH {SEQUENCES}, r AS (SELECT id, q, row_number() OVER (PARTITION BY id ORDER BY q DESC) AS rn FROM items) SELECT id, round(sum(q) FILTER (rn <= 2)::DOUBLE / sum(q), 9) + 0 AS confidence FROM r GROUP BY id""")
def a30_routing_confidence(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", tidy(m.routing_confidence(F.transform("xs", lambda x: x["q"].cast("double")), 2), 9).alias("confidence"))


@query("SELECT user_id, round(count(*) * 100.0 * 6e9 / (3e14 * 8), 9) + 0 AS mfu FROM events GROUP BY 1")
def a38_utilisation(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", tidy(m.utilisation("n", 6e9, 3e14, 8), 9).alias("mfu"))


@query(f"WITH {ROLLOUTS} SELECT DISTINCT step FROM rollouts WHERE step NOT IN (SELECT step FROM rollouts WHERE cents % 100 = 0)")
def a36_stale_labels(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return m.stale_labels(r, r.where("cents % 100 = 0"), "step")


@query("""SELECT DISTINCT 'run_' || (o_custkey % 40) AS run_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 40 NOT IN (3, 4)""")
def s14_discovered_runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    run = F.concat(F.lit("run_"), (F.col("o_custkey") % 40).cast("string"))
    paths = o.select(F.concat(F.lit("/out/"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("log")).otherwise(run), F.lit("/a.json")).alias("path"))
    return rl.discovered_runs(paths, spark.createDataFrame([("run_3",), ("run_4",)], "run_id string"))


@query(f"""WITH {ROLLOUTS}, e AS (SELECT DISTINCT group_id, m FROM rollouts, range(5) r(m)), a AS (SELECT DISTINCT group_id, rollout_id % 4 AS m FROM rollouts WHERE error IS NULL)
    SELECT e.group_id, e.m AS member, CASE WHEN a.m IS NOT NULL THEN NULL WHEN e.m = 4 THEN 'Cancelled' ELSE 'EmptyTrajectory' END AS error FROM e LEFT JOIN a USING (group_id, m)""")
def x4_markers(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    expected = r.select("group_id").distinct().withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("cancelled", F.col("member") == 4)
    arrived = r.where("error is null").select("group_id", (F.col("rollout_id") % 4).alias("member"), "error")
    return rl.with_markers(expected.unionByName(expected), arrived, ["group_id", "member"])


@query(f"""WITH {ROLLOUTS}, g AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM rollouts), s AS (SELECT * FROM g WHERE n >= 4 AND cents % 7 <> 0),
    b AS (SELECT *, (row_number() OVER (PARTITION BY env_name ORDER BY rollout_id) - 1) // 16 AS batch_id, count(*) OVER (PARTITION BY env_name) AS all_n FROM s)
    SELECT rollout_id, batch_id, cents % 4 <> 1 AS shipped FROM b WHERE batch_id < all_n // 16""")
def x2_sink(spark, sf_dir):
    mark = lambda expr: lambda df: df.withColumn("is_filtered", F.expr(expr))
    return sink(rollouts(spark, sf_dir), 4, 16, mark("is_truncated"), mark("cents % 4 = 1"), order="rollout_id", env=("env_name",)).select("rollout_id", "batch_id", "shipped")


@query("""SELECT conv_id, sum(1 + turn % 2)::BIGINT AS n, string_agg(CASE WHEN turn % 2 = 1 THEN turn || ',' || length(text) ELSE turn::VARCHAR END, ',' ORDER BY turn) AS items FROM conversations GROUP BY 1""")
def u6_concatenated_items(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    items = F.when(F.col("turn") % 2 == 1, F.array(F.col("turn").cast("string"), F.length("text").cast("string"))).otherwise(F.array(F.col("turn").cast("string")))
    got = rl.concatenated_items(c.select("conv_id", "turn", items.alias("items")), ["conv_id"], "turn")
    return got.select("conv_id", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("items"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
    SELECT a.conv_id AS rollout_id, a.k::INT AS step, (3 * (a.k + 1))::INT AS tokens, sum(CASE WHEN b.k = 0 THEN 2 ELSE 3 * (b.k + 1) END)::BIGINT AS total FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.k <= a.k GROUP BY ALL""")
def p2_stitched_routes(spark, sf_dir):
    """A turn adds three tokens; its payload begins at the last one before it and gives each of its rows its number."""
    c = read(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("ts"))
    ids = lambda upto: F.flatten(F.transform(upto, lambda t: F.array(t["turn"].cast("long"), t["n"], F.lit(7).cast("long"))))

    def step(t, k):
        before = ids(F.slice(F.col("ts"), F.lit(1), k))
        first = F.greatest(3 * k - 1, F.lit(0))
        rows = F.transform(F.sequence(F.lit(1), F.when(k == 0, F.lit(2)).otherwise(F.lit(3))), lambda _: F.array(k + 1))
        return F.struct(F.concat(before, F.array(t["turn"].cast("long"))).alias("prompt_ids"), F.array(t["n"], F.lit(7).cast("long")).alias("completion_ids"), rows.alias("routed"), first.alias("routed_start"))

    got = tj.routed(turns.select(F.col("conv_id").alias("rollout_id"), F.transform("ts", step).alias("steps")))
    total = F.aggregate(F.flatten("routed"), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("rollout_id", "step", F.size("routed").alias("tokens"), total.alias("total"))


@query(f"""WITH {ROLLOUTS}, s AS (SELECT env_name AS run, rollout_id AS sample, len AS tokens, step, max((step > 6)::INT) OVER (PARTITION BY env_name ORDER BY rollout_id ROWS UNBOUNDED PRECEDING) AS late FROM rollouts),
    u AS (SELECT *, sum(tokens) OVER (ORDER BY CASE run WHEN 'env1' THEN 0 WHEN 'env2' THEN 1 ELSE 2 END, sample ROWS UNBOUNDED PRECEDING) AS used FROM s WHERE late = 0) SELECT run, sample, used::BIGINT AS used FROM u WHERE used <= 60000""")
def p13_selected(spark, sf_dir):
    """The budget is above any sample, so that none is dropped."""
    r = rollouts(spark, sf_dir).select(F.col("env_name").alias("run"), F.col("rollout_id").alias("arrival"), F.col("rollout_id").alias("sample"), F.col("len").alias("tokens"), "step")
    runs = spark.createDataFrame([("env0", 0, 6), ("env1", 1, 6), ("env2", 2, 6)], "run string, place long, current_step long")
    return bt.round_robin_selection(r, runs, 60000, 1)[0].select("run", "sample", "used")


@query(f"""WITH {ROLLOUTS}, s AS (SELECT len, max((step > 6)::INT) OVER (PARTITION BY env_name ORDER BY rollout_id ROWS UNBOUNDED PRECEDING) AS late FROM rollouts) SELECT sum(len)::BIGINT AS tokens, sum(len) >= 100000 AS enough FROM s WHERE late = 0""")
def p14_enough_tokens(spark, sf_dir):
    r = rollouts(spark, sf_dir).select(F.col("env_name").alias("run"), F.col("rollout_id").alias("arrival"), F.col("rollout_id").alias("sample"), F.col("len").alias("tokens"), "step")
    runs = spark.createDataFrame([("env0", 0, 6), ("env1", 1, 6), ("env2", 2, 6)], "run string, place long, current_step long")
    return bt.enough_tokens(r, runs, 100000)


@query(f"""WITH {SEQUENCES}, d AS (SELECT DISTINCT id, size FROM places) SELECT d.id, string_agg(p.token, ',' ORDER BY p.pos) FILTER (p.pos <= 2) AS prompt, string_agg(p.token, ',' ORDER BY p.pos) FILTER (p.pos > 2) AS done FROM d JOIN places p USING (id) WHERE d.id % 3 <> 0 GROUP BY d.id""")
def m10_backfilled(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("full", F.transform("xs", lambda x: x["token"]))
    rendered = F.concat(F.slice("full", F.lit(1), F.lit(2)), F.array(F.lit(-1).cast("long")))
    step = ms.backfilled(rendered, F.col("full"), F.col("id") % 3 != 0)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return s.select("id", step.alias("s")).where("s is not null").select("id", text("s.prompt_ids").alias("prompt"), text("s.completion_ids").alias("done"))


@query(f"""WITH {SEQUENCES} SELECT id, round(sum(CASE WHEN q % 4 = 0 THEN 0 ELSE -d / 10.0 END), 6) + 0 AS total, count(*)::INT AS n FROM items GROUP BY id""")
def m12_teacher_logprobs(spark, sf_dir):
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    s = sequences(spark, sf_dir).withColumn("maps", F.transform("xs", lambda x: F.when(x["q"] % 4 == 0, none).otherwise(F.create_map(F.lit("t"), -x["d"] / 10.0))))
    flat = ms.flattened_teacher_logprobs(F.col("maps"))
    return s.select("id", tidy(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(flat).alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN length(text)::VARCHAR END AS size FROM conversations""")
def m3_parsed_arguments(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 != 0, F.concat(F.lit('{"size": "'), F.length("text").cast("string"), F.lit('"}')))
    call = F.struct(F.lit("c").alias("id"), F.struct(F.lit("f").alias("name"), text.alias("arguments")).alias("function"))
    got = c.withColumn("m", ms.parsed_arguments(F.array(F.struct(F.array(call).alias("tool_calls")))))
    return got.select("conv_id", "turn", F.col("m")[0][0]["arguments"]["size"].alias("size"))


@query("""SELECT row_number() OVER (ORDER BY o_custkey % 3, floor(o_totalprice / 1000) DESC, o_orderkey) AS place, o_orderkey FROM orders""")
def t1_by_run_and_length(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("run_idx"), F.floor(F.col("o_totalprice") / 1000).alias("length"), F.col("o_orderkey").alias("arrival"))
    placed = sp.dense_index(od.by_run_and_length(o).withColumn("order", F.struct("run_idx", (-F.col("length")).alias("l"), "arrival")), "order", "place")
    return placed.select((F.col("place") + 1).alias("place"), F.col("arrival").alias("o_orderkey"))


@query("""SELECT row_number() OVER (ORDER BY p_brand, p_type, p_size, (p_partkey * 37) % 100 DESC, p_name, p_partkey % 2, lpad(p_partkey::VARCHAR, 12, '0')) AS place, p_partkey FROM part""")
def t7_report_order(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model_name"), F.col("p_type").alias("type"), F.col("p_size").alias("seq_len"), (F.col("p_partkey") * 37 % 100).alias("throughput"), F.col("p_name").alias("device_name"),
        (F.col("p_partkey") % 2).alias("ac"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("attention"), "p_partkey",
    )
    order = F.struct("model_name", "type", "seq_len", (-F.col("throughput")).alias("t"), "device_name", "ac", "attention")
    return sp.dense_index(od.report_order(p).withColumn("order", order), "order", "place").select((F.col("place") + 1).alias("place"), "p_partkey")


@query("""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, 2::BIGINT AS epoch, (i + 2 * n + 1)::BIGINT AS step FROM s WHERE i >= n // 3""")
def x8_resumed(spark, sf_dir):
    o = sp.dense_index(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "__index")
    n = o.count()
    return sp.resumed(o, 2 * n + n // 3).select("o_orderkey", "epoch", "step")


@query("""SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY substr(md5('0:' || epoch || ':' || o_orderkey), 1, 15), o_orderkey) - 1 AS place, o_orderkey FROM orders, (VALUES (3), (4)) e(epoch)""")
def o6_epoch_order(spark, sf_dir):
    """Two epochs: each has every row once, in an order of its own."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__index"))
    epoch = lambda e: sp.dense_index(sp.epoch_order(o, e), ["__shuffle", "__index"], "place").select(F.lit(e).alias("epoch"), "place", F.col("__index").alias("o_orderkey"))
    return epoch(3).unionByName(epoch(4))


@query("SELECT o_orderkey, o_comment AS text, split_part(o_orderstatus || '-env@v1.2', '@', 1) AS base, CASE WHEN o_orderkey % 2 = 0 THEN 'SFT LoRA(r=8)' ELSE 'SFT Full' END AS label, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'x:y' END AS o_comment FROM orders)")
def f_text_helpers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("c", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("x:y"))
    rank = F.when(F.col("o_orderkey") % 2 == 0, F.lit(8))
    return o.select("o_orderkey", sc.strip_ansi(F.concat(F.lit("\x1b[31m"), "c", F.lit("\x1b[0m"))).alias("text"), sc.base_environment(F.concat("o_orderstatus", F.lit("-env@v1.2"))).alias("base"), sc.training_label(F.lit("sft"), rank).alias("label"), sc.utc_stamp("o_orderkey").alias("stamp"))


@query("SELECT n_nationkey, replace(replace(' ' || n_name || ' ', ' UNITED ', ' '), ' THE ', ' ').trim() AS short, CASE WHEN n_name LIKE '%A' THEN left(n_name, length(n_name) - 1) ELSE n_name END AS cut FROM nation")
def f_names(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", sc.short_name(F.concat(F.lit("THE "), "n_name"), ["UNITED", "THE"]).alias("short"), sc.remove_suffix("n_name", "A").alias("cut"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '{"k":' || c_custkey || ',"s":"' || c_mktsegment || '"}' END AS js, 'b' || c_custkey AS a, c_mktsegment AS b FROM customer""")
def f_json_and_maps(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    js = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s")))
    both = sc.merged(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("c_mktsegment")), F.create_map(F.lit("a"), F.concat(F.lit("b"), F.col("c_custkey").cast("string"))))
    return c.select("c_custkey", sc.json_text(js).alias("js"), both["a"].alias("a"), both["b"].alias("b"))


@query("""SELECT c_custkey, '{"a": 1.5, "l": [2.5, ' || c_custkey || ']}' AS finite, CASE WHEN c_custkey % 2 = 0 THEN 'd.x,l[1]' ELSE 'l[1]' END AS dropped FROM customer""")
def o19_finite_json(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"a": 1.5, "l": [2.5, NaN, '), key, F.lit("]"), F.when(F.col("c_custkey") % 2 == 0, F.lit(', "d": {"x": -Infinity}}')).otherwise(F.lit("}")))
    got = fl.finite_json(c.select("c_custkey", text.alias("text")), "text")
    return got.select("c_custkey", F.replace("finite", F.lit(', "d": {}'), F.lit("")).alias("finite"), F.array_join("dropped", ",").alias("dropped"))


@query("SELECT l_orderkey AS id, sum(ascii(substr(l_returnflag, 1, 1)))::BIGINT AS total, count(*)::INT AS n FROM lineitem GROUP BY 1")
def s15_decoded_bytes(spark, sf_dir):
    flags = F.array_join(F.transform("xs", lambda x: x["flag"]), "")
    got = sequences(spark, sf_dir).select("id", ar.decode_bytes(F.base64(flags.cast("binary"))).alias("b"))
    return got.select("id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("b").alias("n"))


@query("SELECT l_orderkey AS id, max(l_linenumber)::BIGINT AS last FROM lineitem GROUP BY 1")
def k6_logged_samples(spark, sf_dir):
    return wr.logged_sample(sequences(spark, sf_dir), "xs").select("id", F.col("last_step.n").alias("last"))


@query("SELECT o_orderkey, o_orderkey % 4 AS worker FROM orders WHERE o_orderkey % 4 = 2")
def s9_for_rank(spark, sf_dir):
    return rd.for_rank(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("worker")), 2)


@query("SELECT n_nationkey, [x FOR x IN [1, 2, 4, 8, 16, 32] IF x <= n_nationkey] AS powers FROM nation")
def f_powers(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", F.transform(ar.powers_of_two("n_nationkey"), lambda x: x.cast("int")).alias("powers"))


def _ids_text(ids):
    return F.concat_ws(",", F.transform(ids, lambda x: x.cast("string")))


@query(f"""WITH {SEQUENCES}, g AS (SELECT id, unnest(range(1, 5)) AS i FROM (SELECT DISTINCT id FROM places) d)
    SELECT g.id, string_agg(coalesce(p.token, 0)::VARCHAR, ',' ORDER BY g.i) AS ids FROM g LEFT JOIN places p ON p.id = g.id AND p.pos = g.i GROUP BY g.id""")
def f_align_length(spark, sf_dir):
    ids = F.transform("xs", lambda x: x["token"])
    return sequences(spark, sf_dir).select("id", _ids_text(ar.align_length(ids, 4, F.lit(0).cast("long"))).alias("ids"))


@query(f"""WITH {SEQUENCES}, k AS (SELECT *, token % 5 = 0 AS hit FROM places)
    SELECT id, coalesce(string_agg(token::VARCHAR, ',' ORDER BY pos) FILTER (hit), string_agg(supp::VARCHAR, ',' ORDER BY pos)) AS ids FROM k GROUP BY id""")
def f_first_non_empty(spark, sf_dir):
    hits = F.filter(F.transform("xs", lambda x: x["token"]), lambda t: t % 5 == 0)
    return sequences(spark, sf_dir).select("id", _ids_text(ar.first_non_empty(F.lit(None).cast("array<bigint>"), hits, F.transform("xs", lambda x: x["supp"]))).alias("ids"))


@query(f"""WITH {SEQUENCES}, e AS (SELECT id, max(q) FILTER (pos = 1) AS head, max(q) FILTER (pos = size) AS tail FROM places GROUP BY id)
    SELECT id, round(2.5 * head / (head + tail), 6) + 0.0 AS head_weight, round(2.5 * tail / (head + tail), 6) + 0.0 AS tail_weight FROM e""")
def t10_normalised_weights(spark, sf_dir):
    scores = F.transform("xs", lambda x: x["q"])
    w = od.normalised_weights(scores, F.array(F.lit(0), F.size("xs") - 1), 2.5)
    return sequences(spark, sf_dir).select("id", tidy(w[0], 6).alias("head_weight"), tidy(w[1], 6).alias("tail_weight"))


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, concat_ws(',', CASE WHEN cents % 3 <> 0 THEN 'a' END, CASE WHEN cents % 5 <> 0 THEN 'b' END, CASE WHEN cents % 7 <> 0 THEN 'c' END) AS kept FROM rollouts""")
def o19_finite_values(spark, sf_dir):
    c = F.col("cents")
    bad = lambda k, x: F.when(c % k == 0, F.lit(x).cast("double")).otherwise(c.cast("double"))
    values = F.create_map(F.lit("a"), bad(3, "NaN"), F.lit("b"), bad(5, "-Infinity"), F.lit("c"), bad(7, None))
    return rollouts(spark, sf_dir).select("rollout_id", F.concat_ws(",", F.map_keys(ar.drop_non_finite_values(values))).alias("kept"))


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, round(2 * (reward - avg(reward) OVER (PARTITION BY group_id)), 6) + 0.0 AS advantage FROM rollouts""")
def a2_custom_advantage(spark, sf_dir):
    r = rollouts(spark, sf_dir).select("rollout_id", "group_id", "reward")
    return custom_advantage(r, lambda g: 2 * (g["reward"] - g["reward"].mean())).select("rollout_id", tidy(F.col("advantage"), 6).alias("advantage"))


@query(f"""WITH {ROLLOUTS} SELECT rollout_id, step + 1 - policy_version > 3 AS paused FROM rollouts""")
def x6_lead_gate(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout_id", lead_gate("step", "policy_version", 3).alias("paused"))


@query(f"""WITH {SEQUENCES} SELECT id, round(sum(-d / 10.0) - (4 - count(*) % 4) % 4 * ln(128), 6) + 0.0 AS logprobs, round((4 - count(*) % 4) % 4 * ln(128), 6) + 0.0 AS entropy FROM places GROUP BY id""")
def l7_uniform_pads(spark, sf_dir):
    lp = F.transform("xs", lambda x: -x["d"] / 10.0)
    none = F.transform("xs", lambda x: F.lit(0.0))
    s = sequences(spark, sf_dir).select("id", ar.pad_to_multiple(lp, 4, ar.uniform_logprob_pad(128)).alias("lp"), ar.pad_to_multiple(none, 4, ar.uniform_entropy_pad(128)).alias("ent"))
    return s.select("id", tidy(ar.total("lp"), 6).alias("logprobs"), tidy(ar.total("ent"), 6).alias("entropy"))
