"""Lookups, differences, interleaving and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollsift.operators import messages as ms
from rollsift.operators import ordering as od
from rollsift.operators import relations as rl
from rollsift.operators import sampling as sp
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, read, rollouts


@query("""WITH d AS (SELECT DISTINCT o_custkey AS run FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT DISTINCT o_custkey AS run FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT c_custkey AS run FROM customer WHERE c_custkey % 10 = 0)
    SELECT run, 'new' AS change FROM d WHERE run NOT IN (SELECT run FROM e) AND run NOT IN (SELECT run FROM k)
    UNION ALL SELECT run, 'deleted' FROM k WHERE run NOT IN (SELECT run FROM d WHERE run NOT IN (SELECT run FROM e))""")
def j4_changes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey")
    evicted = read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("run"))
    new, deleted = rl.changes(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0"), "run", evicted)
    return new.withColumn("change", F.lit("new")).unionByName(deleted.withColumn("change", F.lit("deleted")))


@query(f"WITH {ROLLOUTS} SELECT rollout_id, lag(cents) OVER (PARTITION BY env_name ORDER BY rollout_id) AS previous_cents FROM rollouts")
def j8_previous(spark, sf_dir):
    return rl.previous(rollouts(spark, sf_dir), ["env_name"], "rollout_id", ["cents"]).select("rollout_id", "previous_cents")


@query(f"WITH {ROLLOUTS}, s AS (SELECT DISTINCT env_name, step FROM rollouts), m AS (SELECT DISTINCT env_name, step FROM rollouts WHERE cents % 97 = 0) SELECT * FROM s SEMI JOIN m USING (env_name, step)")
def j12_stable_steps(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    keys = ["env_name", "step"]
    return rl.stable_steps(r.select(*keys).distinct(), r.where("cents % 97 = 0"), keys)


@query(f"""WITH {ROLLOUTS}, l AS (SELECT step, rollout_id, row_number() OVER (PARTITION BY step ORDER BY rollout_id) AS pos FROM rollouts),
    r AS (SELECT step, cents AS teacher, row_number() OVER (PARTITION BY step ORDER BY cents, rollout_id) AS pos FROM rollouts) SELECT step, rollout_id, teacher FROM l JOIN r USING (step, pos)""")
def j7_paired_by_position(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    right = r.select("step", F.col("cents").alias("teacher"), F.struct("cents", "rollout_id").alias("o"))
    return rl.paired_by_position(r.select("step", "rollout_id"), right, ["step"], "rollout_id", "o").select("step", "rollout_id", "teacher")


@query("""WITH p AS (SELECT doc_id, string_split(text, ' ') AS ids FROM documents WHERE text IS NOT NULL), q AS (SELECT min(doc_id) AS prefix_id, ids[1:greatest(1, len(ids) * (1 + doc_id % 3) // 3)] AS prefix FROM p GROUP BY 2),
    m AS (SELECT p.doc_id, q.prefix_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY len(q.prefix) DESC, q.prefix_id) AS r FROM p JOIN q ON p.ids[1] = q.prefix[1] AND p.ids[1:len(q.prefix)] = q.prefix)
    SELECT doc_id, prefix_id FROM m WHERE r = 1""")
def j9_longest_prefix(spark, sf_dir):
    """Each text's words against a third, two thirds or all of the words of every text."""
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("ids")).withColumn("head", F.element_at("ids", 1))
    length = F.greatest(F.floor(F.size("ids") * (1 + F.col("doc_id") % 3) / 3), F.lit(1)).cast("int")
    prefixes = d.select("head", F.col("doc_id").alias("prefix_id"), F.slice("ids", F.lit(1), length).alias("prefix"))
    return od.longest_prefix(d, prefixes, "head").select("doc_id", "prefix_id")


@query(f"WITH {ROLLOUTS} SELECT DISTINCT env_name FROM (SELECT env_name FROM rollouts WHERE error IS NULL UNION ALL SELECT env_name FROM rollouts WHERE error IS NOT NULL)")
def u3_environment_union(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return rl.env_union(r.where("error is null"), r.where("error is not null"))


@query(f"WITH {ROLLOUTS} SELECT group_id, string_agg(cents::VARCHAR, ',' ORDER BY rollout_id) AS cents FROM rollouts GROUP BY group_id")
def o26_to_columns(spark, sf_dir):
    df = rl.to_columns(rollouts(spark, sf_dir).select("group_id", "rollout_id", "cents"), ["group_id"], "rollout_id")
    return df.select("group_id", F.array_join(F.transform("cents", lambda x: x.cast("string")), ",").alias("cents"))


@query(f"WITH {ROLLOUTS} SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY rollout_id) - 1 AS position, cents FROM rollouts")
def o26_to_rows(spark, sf_dir):
    wide = rl.to_columns(rollouts(spark, sf_dir).select("group_id", "rollout_id", "cents"), ["group_id"], "rollout_id")
    return rl.to_rows(wide, ["group_id"])


@query(f"WITH {ROLLOUTS}, l AS (SELECT step, env_name, count(*) AS n FROM rollouts GROUP BY ALL) SELECT step, arg_min(env_name, (n, env_name)) AS client FROM l GROUP BY step")
def t4_least_loaded(spark, sf_dir):
    loads = rollouts(spark, sf_dir).groupBy("step", F.col("env_name").alias("client")).agg(F.count("*").alias("in_flight"))
    return od.least_loaded(loads, ["step"])


@query(f"WITH {ROLLOUTS}, o AS (SELECT rollout_id, step, min(step) OVER (PARTITION BY example_id) AS first FROM rollouts) SELECT rollout_id FROM o WHERE step = first")
def t5_oldest_step(spark, sf_dir):
    return od.oldest_step(rollouts(spark, sf_dir), run="example_id").select("rollout_id")


@query(f"""WITH {ROLLOUTS}, n AS (SELECT rollout_id, env_name, (row_number() OVER (PARTITION BY env_name ORDER BY rollout_id) - 1) // 64 AS batch_id, count(*) OVER (PARTITION BY env_name) AS n FROM rollouts WHERE error IS NULL)
    SELECT rollout_id, batch_id FROM n WHERE batch_id < n // 64""")
def t8_batches(spark, sf_dir):
    return od.batches_of(rollouts(spark, sf_dir).where("error is null"), 64, "rollout_id", ["env_name"]).select("rollout_id", "batch_id")


@query(f"""WITH RECURSIVE {ROLLOUTS}, r AS (SELECT step, len, rollout_id, row_number() OVER (PARTITION BY step ORDER BY rollout_id) AS pos FROM rollouts),
    walk AS (SELECT step, rollout_id, pos, 0::BIGINT AS batch, len AS held FROM r WHERE pos = 1
        UNION ALL SELECT r.step, r.rollout_id, r.pos, CASE WHEN w.held >= 3000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held >= 3000 THEN r.len ELSE w.held + r.len END FROM walk w JOIN r ON r.step = w.step AND r.pos = w.pos + 1),
    t AS (SELECT *, max(held) OVER (PARTITION BY step, batch) AS total FROM walk) SELECT rollout_id, batch AS batch_id FROM t WHERE total >= 3000""")
def t9_token_batches(spark, sf_dir):
    return od.token_batches(rollouts(spark, sf_dir).select("rollout_id", "step", "len"), 3000, "rollout_id", ["step"], tokens="len").select("rollout_id", "batch_id")


@query("""WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), b AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    g AS (SELECT unnest(range((SELECT greatest(max(a.n), max(b.n)) FROM a, b) * 2)) AS place)
    SELECT place, coalesce(a.k, b.k) AS k FROM g LEFT JOIN a ON place % 2 = 0 AND a.i = (place // 2) % a.n LEFT JOIN b ON place % 2 = 1 AND b.i = (place // 2) % b.n""")
def o4_interleave_all(spark, sf_dir):
    a = sp.dense_index(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "__index")
    b = sp.dense_index(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", "__index")
    return sp.interleave([a, b], until="all_exhausted").select(F.col("__place").alias("place"), "k")


@query("""WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), b AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n)
    SELECT i * 2 AS place, k FROM a, n WHERE i < n UNION ALL SELECT i * 2 + 1, k FROM b, n WHERE i < n""")
def o4_interleave_first(spark, sf_dir):
    a = sp.dense_index(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "__index")
    b = sp.dense_index(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", "__index")
    return sp.interleave([a, b]).select(F.col("__place").alias("place"), "k")


# draws and orders are hashes that SQL has too
_NUMBER = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


@query(f"""WITH s AS (SELECT p_type AS env_name, count(*) AS n, row_number() OVER (ORDER BY p_type) AS pos FROM part GROUP BY 1),
    u AS (SELECT env_name, n, sum(n::DOUBLE / (SELECT sum(n)::DOUBLE FROM s)) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upper, pos FROM s),
    d AS (SELECT draw, {_NUMBER.format("'3:' || draw")}::DOUBLE / 1152921504606846976 AS x FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS draw)),
    p AS (SELECT draw, coalesce((SELECT arg_min(env_name, pos) FROM u WHERE x < upper), (SELECT arg_max(env_name, pos) FROM u)) AS source FROM d),
    q AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS position FROM p),
    e AS (SELECT draw, source, position, position // n AS epoch, position % n AS pos FROM q JOIN s ON env_name = source),
    o AS (SELECT p_type AS source, epoch, p_partkey, row_number() OVER (PARTITION BY p_type, epoch ORDER BY {_NUMBER.format("'3:' || epoch || ':' || p_partkey")}, p_partkey) - 1 AS pos FROM part JOIN (SELECT DISTINCT source, epoch FROM e) x ON x.source = p_type)
    SELECT draw, source, position, epoch, p_partkey AS example_id FROM e JOIN o USING (source, epoch, pos)""")
def o1_weighted_schedule(spark, sf_dir):
    data = read(spark, sf_dir, "part").select(F.col("p_type").alias("env_name"), F.col("p_partkey").alias("example_id"))
    weights = [(r[0], float(r[1])) for r in data.groupBy("env_name").count().orderBy("env_name").collect()]  # a number a source
    return sp.scheduled_examples(sp.weighted_schedule(spark, weights, data.count(), 3), data, seed=3).select("draw", "source", "position", "epoch", "example_id")


@query(f"""WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), b AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    d AS (SELECT draw, CASE WHEN {_NUMBER.format("'5:' || draw")}::DOUBLE / 1152921504606846976 < 0.8 THEN 0 ELSE 1 END AS source FROM (SELECT unnest(range(20 * ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)))) AS draw)),
    p AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS position FROM d),
    e AS (SELECT max(draw) AS last FROM p WHERE (source = 0 AND position = (SELECT max(i) FROM a)) OR (source = 1 AND position = (SELECT max(i) FROM b)))
    SELECT draw AS __place, coalesce(a.k, b.k) AS k FROM p JOIN e ON draw <= last LEFT JOIN a ON source = 0 AND a.i = position % a.n LEFT JOIN b ON source = 1 AND b.i = position % b.n""")
def o5_interleave_by_probability(spark, sf_dir):
    a = sp.dense_index(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "__index")
    b = sp.dense_index(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", "__index")
    return sp.interleave_by_probability([a, b], [0.8, 0.2], seed=5, until="all_exhausted").select("__place", "k")


@query(f"WITH {ROLLOUTS} SELECT env_name, s AS step, i AS every, CASE WHEN s = 0 THEN false ELSE s % i = 0 END AS fires FROM (SELECT DISTINCT env_name, step AS s FROM rollouts), (VALUES (3), (10)) t(i)")
def o2_evaluation_fires(spark, sf_dir):
    grid = rollouts(spark, sf_dir).select("env_name", "step").distinct().withColumn("every", F.explode(F.array(F.lit(3), F.lit(10))))
    return grid.withColumn("fires", sp.evaluation_fires(F.col("step"), F.col("every"), 0, skip_first=True))


@query(f"WITH {ROLLOUTS} SELECT rollout_id, row_number() OVER (PARTITION BY env_name ORDER BY rollout_id) AS turn FROM rollouts")
def o3_round_robin(spark, sf_dir):
    return sp.round_robin(rollouts(spark, sf_dir), "env_name", "rollout_id").select("rollout_id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {ROLLOUTS} SELECT rollout_id, (step - 1) // 7 AS epoch FROM rollouts WHERE step > 0 AND (step - 1) % 4 = 2")
def o7_rank_share(spark, sf_dir):
    return sp.rank_share(rollouts(spark, sf_dir).where("step > 0"), 2, 4).select("rollout_id", sp.epoch_of(F.col("step"), 7).alias("epoch"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def s6_head(spark, sf_dir):
    return sp.head(read(spark, sf_dir, "orders").select("o_orderkey"), 25, "o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS __index, 'base' AS __subset, 'train' AS __split FROM customer")
def s1_tagged(spark, sf_dir):
    return sp.tagged(read(spark, sf_dir, "customer").select("c_custkey"), "base", "train", "c_custkey")


@query("SELECT conv_id, turn, role IN ('user', 'tool') AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS generation_prompt FROM conversations")
def m5_generation_prompt(spark, sf_dir):
    return ms.wants_generation_prompt(read(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "generation_prompt")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE 'tool' END AS role FROM conversations), n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM r)
    SELECT conv_id, turn, role FROM n WHERE NOT (role = 'tool' AND coalesce(next, '') = 'tool')""")
def m6_collapsed_tools(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise("tool"))
    return ms.collapsed_tools(c, ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role = 'assistant' AS trained FROM conversations")
def m4_role_mask(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ms.role_mask(F.col("role")).alias("trained"))


@query("""WITH m AS (SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS chat FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)
    SELECT conv_id, chat FROM m UNION ALL SELECT conv_id, 'user:' || length(arg_min(text, turn)) || ',assistant:' || length(arg_max(text, turn)) FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id""")
def m2_resolved_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = c.groupBy("conv_id").agg(turns.alias("t"), F.min_by("text", "turn").alias("prompt"), F.max_by("text", "turn").alias("completion"))
    df = df.withColumn("messages", F.when(F.col("conv_id") % 2 == 0, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))))
    line = F.transform("chat", lambda x: F.concat_ws(":", x["role"], F.length(x["content"]).cast("string")))
    return ms.resolved(df).select("conv_id", F.array_join(line, ",").alias("chat"))


@query()
def m7_tokenised(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    chats = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("chat"))

    def render(messages: list[dict], ask: bool) -> list[int]:
        out = [b for x in messages for b in (256, *x["role"][:1].encode(), *(x["content"] or "").encode(), 257)]
        return out + ([256, 97] if ask else [])

    return ms.tokenised(chats, render, keep=("conv_id",))


@query("""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN base64(encode(source)) END AS data FROM documents)
    SELECT doc_id, CASE WHEN data IS NULL THEN 'http://x/' || doc_id ELSE 'file:///img/' || left(sha256(data), 16) || '.png' END AS url FROM u""")
def m11_offloaded_images(spark, sf_dir):
    data = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("source", "utf-8")))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, data).otherwise(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("url"))
    return ms.offloaded_images(d, "url", "/img")[0]
