"""Queries of the probability algebra and of decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.functions import prob, rules
from plyframe.operators import batches, decode

from . import adapters
from .game_queries import _LEGAL_SQL, GAMES_SQL

_Z64 = "z AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS z FROM embeddings)"
_P64 = _Z64 + ", e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"
_P163 = (
    "z163 AS (SELECT vec_id, vec_id // 40 AS game, vec_id % 40 AS ply, c AS i, 8.0::DOUBLE * embedding[c % 64 + 1]::DOUBLE + ((c * 37 + vec_id * 11) % 101)::DOUBLE / 50.0::DOUBLE AS z FROM embeddings, range(163) r(c)),"
    " e163 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z163), p163 AS (SELECT vec_id, game, ply, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e163)"
)


def _exploded(df: DataFrame, array: str, *keys: str, name: str = "p") -> DataFrame:
    return df.select(*keys, F.posexplode_outer(F.col(array)).alias("i", name))


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: softmax of logits, one row per class."""
    p = adapters.logits64(spark, sf_dir).select("vec_id", F.expr(prob.softmax("z")).alias("p"))
    return _exploded(p, "p", "vec_id").select("vec_id", "i", F.round("p", 6).alias("p"))


def softmax_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 with a temperature of 2: the largest probability of each row."""
    p = adapters.logits64(spark, sf_dir).select("vec_id", F.expr(prob.softmax("z", "2D")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("p_max"))


def masked_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class but the last (`empty`)."""
    p = adapters.plies163(spark, sf_dir)
    return p.select("game", "ply", F.expr(prob.argmax(prob.masked("p", f"i <> {prob.EMPTY_MOVE}"))).alias("raw"), F.expr(prob.argmax("p")).alias("unmasked"))


def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest classes in order."""
    top = adapters.plies163(spark, sf_dir).select("game", "ply", F.expr(prob.topk("p", 5)).alias("t"))
    return top.select("game", "ply", F.posexplode_outer("t").alias("rank", "x")).select("game", "ply", "rank", F.col("x.i").alias("class_idx"), F.round(-F.col("x.np"), 6).alias("p"))


def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a distribution over classes 10-39, null where nothing is left."""
    p = adapters.logits64(spark, sf_dir).select("vec_id", F.expr(prob.softmax("z")).alias("p")).select("vec_id", F.expr(prob.class_filter("p", "i between 10 and 39 and vec_id % 50 <> 7")).alias("f"))
    return p.select("vec_id", F.expr("round(f[25], 6)").alias("p25"), F.expr(f"if(f is null, null, {prob.argmax('f')})").alias("best"))


def allowed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """renormalised over an allowed list given by the user, in their order; the
    first of equals wins."""
    allowed = spark.createDataFrame([(0, 31), (1, 7), (2, 18), (3, 44)], "ord int, i int")
    p = _exploded(adapters.logits64(spark, sf_dir).select("vec_id", F.expr(prob.softmax("z")).alias("p")), "p", "vec_id").join(F.broadcast(allowed), "i")
    p = p.withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("vec_id")))
    return p.groupBy("vec_id").agg(F.min(F.struct(-F.col("q"), "ord", "i")).alias("b")).select("vec_id", F.col("b.i").alias("pick"), F.round(-F.col("b").getField("col1"), 6).alias("p"))


def ply_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: mass by source hole, landing hole and tuzdyk mark."""
    m = adapters.plies163(spark, sf_dir).select("game", "ply", F.expr(decode.marginals("p")).alias("m"))
    return m.select("game", "ply", F.round("m.x", 6).alias("x_mass"), F.posexplode_outer(F.arrays_zip("m.src", "m.land")).alias("hole", "s")).select("game", "ply", "hole", F.round("s.src", 6).alias("src"), F.round("s.land", 6).alias("land"), "x_mass")


def tta_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: mean of the distributions of up to seven shifted views of a cell."""
    p = adapters.logits64(spark, sf_dir).select(F.expr("vec_id div 7").alias("cell"), F.expr(prob.softmax("z")).alias("p"))
    return _exploded(p, "p", "cell").groupBy("cell", "i").agg(F.round(F.avg("p"), 6).alias("p"), F.count("*").alias("views"))


def class_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 163 move classes by cross product, with their closed-form index."""
    holes = spark.range(1, 10)
    rows = holes.select(F.col("id").alias("s")).crossJoin(holes.select(F.col("id").alias("e"))).crossJoin(spark.range(2).select(F.col("id").alias("x")))
    named = rows.select((2 * (9 * (F.col("s") - 1) + F.col("e") - 1) + F.col("x")).alias("idx"), F.concat(F.col("s").cast("string"), F.col("e").cast("string"), F.when(F.col("x") == 1, "x").otherwise("")).alias("class"))
    return named.unionByName(spark.range(1).select(F.lit(162).cast("long").alias("idx"), F.lit("empty").alias("class")))


def class_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every move class with the number of events that read it, 0 included."""
    reads = adapters.table(spark, sf_dir, "events").groupBy((F.col("event_id") * F.col("event_id") % 163).alias("idx")).agg(F.count("*").alias("n"))
    return class_domain(spark, sf_dir).join(reads, "idx", "left").select("idx", "class", F.coalesce("n", F.lit(0)).alias("n"))


def class_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top class indices joined with their names (163 rows, so broadcast)."""
    top = adapters.plies163(spark, sf_dir).select("game", "ply", F.expr(prob.argmax("p")).cast("long").alias("idx"))
    return top.join(F.broadcast(class_domain(spark, sf_dir)), "idx").select("game", "ply", "idx", "class")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States before each ply of the games that have distributions: no other game is
    played, and none beyond the 40 plies that a sheet has distributions for."""
    wanted = adapters.logits64(spark, sf_dir).select(F.expr("vec_id div 40").alias("user_id")).distinct()
    return adapters.plies(spark, sf_dir, wanted, 40).select(F.col("user_id").alias("game"), (F.col("ply") - 1).alias("ply"), "before")


def legal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal moves by score, with the share of the sum for reports."""
    p = adapters.plies163(spark, sf_dir).join(_positions(spark, sf_dir), ["game", "ply"]).select("game", "ply", "p", "before", F.expr(decode.marginals("p")).alias("m"))
    scored = p.select("game", "ply", F.expr(decode.scored_moves("before", "p", "m")).alias("s")).withColumn("t", F.expr("aggregate(s, 0D, (t, x) -> t - x.neg)"))
    return scored.select("game", "ply", "t", F.posexplode_outer("s").alias("rank", "x")).select("game", "ply", "rank", F.col("x.notation").alias("notation"), F.round(-F.col("x.neg"), 6).alias("score"), F.round(F.expr("-x.neg / if(t = 0, 1D, t)"), 6).alias("share"))


def legal_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal moves by their own class probability rounded to 4, ties by text."""
    p = adapters.plies163(spark, sf_dir).join(_positions(spark, sf_dir), ["game", "ply"])
    notes = F.expr(f"array_sort({rules.notations('before')})")
    alt = p.select("game", "ply", "p", notes.alias("n")).select("game", "ply", F.expr(f"array_sort(transform(n, (t, i) -> named_struct('np', -round(p[{decode.class_index('t')}], 4), 'i', i, 't', t)))").alias("a"))
    return alt.select("game", "ply", F.posexplode_outer("a").alias("rank", "x")).select("game", "ply", "rank", F.col("x.t").alias("notation"), (-F.col("x.np")).alias("p"))


def _n_vectors(spark: SparkSession, sf_dir: str) -> int:
    return adapters.table(spark, sf_dir, "embeddings").count()


def evidence_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood given the board of a diagram after every 20th ply."""
    boards = adapters.boards(spark, sf_dir)
    seen = adapters.diagram_cells(boards.select("user_id", "ply"), _n_vectors(spark, sf_dir))
    read = seen.join(adapters.diagrams85(spark, sf_dir), "vec_id").select("user_id", "ply", "k", F.expr(decode.diagram_filter("k", "p")).alias("d"))
    checks = read.groupBy("user_id", "ply").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("check")).select("user_id", "ply", F.col("check.d").alias("check"))
    return boards.join(checks, ["user_id", "ply"]).select("user_id", "ply", F.round(F.expr(decode.evidence("g", "check")), 6).alias("logp"))


def beam_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked widths against the memory bound."""
    asked = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 - 500).alias("asked"), (F.col("p_size") % 12).alias("per_ply"))
    return asked.select("k", "asked", "per_ply", decode.beam_cap(F.col("asked"), F.col("per_ply")).alias("width"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ply (from 0), k and p: the diagram after every 20th ply of plies163."""
    plies = adapters.plies163(spark, sf_dir).filter("(ply + 1) % 20 = 0").select(F.col("game").alias("user_id"), "ply")
    return adapters.diagram_cells(plies, _n_vectors(spark, sf_dir)).join(adapters.diagrams85(spark, sf_dir), "vec_id")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, ply and check: these diagrams, gathered."""
    read = _seen(spark, sf_dir).select("user_id", "ply", "k", F.expr(decode.diagram_filter("k", "p")).alias("d")).groupBy("user_id", "ply").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("c"))
    return read.select(F.col("user_id").alias("game"), "ply", F.col("c.d").alias("check"))


def _beams(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    dist = adapters.plies163(spark, sf_dir).select("game", "ply", F.struct("p", F.expr(decode.marginals("p")).alias("marg"), F.lit(None).cast(decode.CHECK).alias("check")).alias("q"))
    games = dist.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("ply", "q"))).alias("d")).select("game", F.col("d.q").alias("d"))
    return games.select("game", F.expr(decode.beam("d", width)).alias("b"))


def _finals(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    best = _beams(spark, sf_dir, width).select("game", F.expr(decode.beam_final("b", "cast(null as int)")).alias("h"), F.expr("array_max(transform(concat(b.active, b.finished), h -> h.logp))").alias("logp"))
    return best.select("game", F.array_join("h.moves", " ").alias("moves"), F.array_join("h.state.pits", ",").alias("pits"), F.round("logp", 4).alias("best_logp"))


def beam_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 with one hypothesis: greedy decoding of whole games."""
    return _finals(spark, sf_dir, 1)


def beam_w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 with 16 hypotheses, whole games."""
    return _finals(spark, sf_dir, 16)


def beam_w1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D3, T4 with 1,024 hypotheses a game and the evidence of diagrams."""
    dists = adapters.plies163(spark, sf_dir)
    cells = dists.select(F.col("game").alias("sheet"), F.col("ply").alias("move_no"), F.lit("W").alias("side"), F.lit(1.0).alias("ink"), "p")
    seen = _seen(spark, sf_dir).select(F.col("user_id").alias("sheet"), (F.col("ply") + 1).alias("ply"), F.col("ply").alias("move_no"), F.lit("pit").alias("kind"), F.lit("W").alias("side"), "k", F.lit(0).alias("pit_index"), "p")
    best = batches.read_batches(cells, seen, width=1024, whole=True, records=False)
    return best.select(F.col("sheet").alias("game"), F.array_join("moves", " ").alias("moves"), F.round("logp", 4).alias("logp"), F.array_join("state.pits", ",").alias("pits"))


def beam_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick among all hypotheses of whole games when a result is stated."""
    b = _beams(spark, sf_dir, 8)
    return b.select("game", F.expr(decode.beam_final("b", "int(game % 3) - 1")).alias("h")).select("game", F.array_join("h.moves", " ").alias("moves"))


QUERIES = {f.__name__: f for f in (softmax, softmax_temp, masked_argmax, topk_classes, class_filter, allowed_pick, ply_marginals, tta_mean, class_domain, class_reads, class_dim_join, legal_scores, legal_alternatives, evidence_logp, beam_cap, beam_w1, beam_w16, beam_w1024, beam_final)}

_NAMES = "dim AS (SELECT 2 * (9 * (s - 1) + e - 1) + x AS idx, s::VARCHAR || e::VARCHAR || CASE WHEN x = 1 THEN 'x' ELSE '' END AS class FROM range(1, 10) a(s), range(1, 10) b(e), range(2) c(x) UNION ALL SELECT 162, 'empty')"
_SCORES = (
    GAMES_SQL + "," + _LEGAL_SQL + "," + _P163
    + """, mx AS (SELECT game, ply, i, p, CASE WHEN i < 162 THEN i // 18 END AS s, CASE WHEN i < 162 THEN (i // 2) % 9 END AS l, i % 2 = 1 AS x FROM p163),
    src AS (SELECT game, ply, s, sum(p) AS v FROM mx WHERE i < 162 GROUP BY ALL), land AS (SELECT game, ply, l, sum(p) AS v FROM mx WHERE i < 162 GROUP BY ALL),
    xm AS (SELECT game, ply, sum(CASE WHEN x AND i < 162 THEN p ELSE 0 END) AS v FROM mx GROUP BY ALL),
    sc AS (SELECT n.user_id AS game, n.ply, n.notation, p.p AS own, (0.5 * p.p + 0.5 * s.v * l.v * 9) * CASE WHEN n.notation LIKE '%x' THEN xm.v ELSE 1 - xm.v END AS score,
           n.notation[1]::BIGINT - 1 AS a FROM named n JOIN st b ON b.user_id = n.user_id AND b.ply = n.ply
           JOIN plies nx ON nx.user_id = n.user_id AND nx.ply = n.ply + 1
           JOIN src s ON s.game = n.user_id AND s.ply = n.ply AND s.s = n.notation[1]::BIGINT - 1 JOIN land l ON l.game = n.user_id AND l.ply = n.ply AND l.l = n.notation[2]::BIGINT - 1
           JOIN xm ON xm.game = n.user_id AND xm.ply = n.ply
           JOIN p163 p ON p.game = n.user_id AND p.ply = n.ply AND p.i = 2 * (9 * (n.notation[1]::BIGINT - 1) + n.notation[2]::BIGINT - 1) + CASE WHEN n.notation LIKE '%x' THEN 1 ELSE 0 END)
    """
)

ORACLE = {
    "softmax": f"WITH {_P64} SELECT vec_id, i, round(p, 6) AS p FROM p",
    "softmax_temp": f"WITH {_Z64}, e AS (SELECT *, exp((z - max(z) OVER (PARTITION BY vec_id)) / 2) AS e FROM z) SELECT vec_id, round(max(e) / sum(e), 6) AS p_max FROM e GROUP BY vec_id",
    "masked_argmax": f"WITH {_P163} SELECT game, ply, (list(i ORDER BY p DESC, i) FILTER (WHERE i <> 162))[1] AS raw, (list(i ORDER BY p DESC, i))[1] AS unmasked FROM p163 GROUP BY game, ply",
    "topk_classes": f"WITH {_P163}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) - 1 AS rank FROM p163) SELECT game, ply, rank, i AS class_idx, round(p, 6) AS p FROM r WHERE rank < 5",
    "class_filter": f"WITH {_P64}, f AS (SELECT *, CASE WHEN i BETWEEN 10 AND 39 AND vec_id % 50 <> 7 THEN p ELSE 0 END AS m FROM p), t AS (SELECT *, sum(m) OVER (PARTITION BY vec_id) AS t FROM f) "
    "SELECT vec_id, max(CASE WHEN i = 25 AND t >= 1e-6 THEN round(m / t, 6) END) AS p25, CASE WHEN max(t) >= 1e-6 THEN (list(i ORDER BY m DESC, i))[1] END AS best FROM t GROUP BY vec_id",
    "allowed_pick": f"WITH {_P64}, a AS (SELECT * FROM (VALUES (0, 31), (1, 7), (2, 18), (3, 44)) v(ord, i)), q AS (SELECT vec_id, a.ord, p.i, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM p JOIN a ON a.i = p.i), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, ord) AS rn FROM q) SELECT vec_id, i AS pick, round(q, 6) AS p FROM r WHERE rn = 1",
    "ply_marginals": f"WITH {_P163}, m AS (SELECT * FROM p163 WHERE i < 162), s AS (SELECT game, ply, i // 18 AS hole, sum(p) AS src FROM m GROUP BY ALL), l AS (SELECT game, ply, (i // 2) % 9 AS hole, sum(p) AS land FROM m GROUP BY ALL), "
    "x AS (SELECT game, ply, sum(p) FILTER (WHERE i % 2 = 1) AS x FROM m GROUP BY ALL) SELECT game, ply, hole, round(src, 6) AS src, round(land, 6) AS land, round(x, 6) AS x_mass FROM s JOIN l USING (game, ply, hole) JOIN x USING (game, ply)",
    "tta_mean": f"WITH {_P64} SELECT vec_id // 7 AS cell, i, round(avg(p), 6) AS p, count(*) AS views FROM p GROUP BY ALL",
    "class_domain": f"WITH {_NAMES} SELECT idx, class FROM dim",
    "class_reads": f"WITH {_NAMES} SELECT idx, class, count(event_id) AS n FROM dim LEFT JOIN events ON event_id * event_id % 163 = idx GROUP BY ALL",
    "class_dim_join": f"WITH {_P163}, {_NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rn FROM p163) SELECT game, ply, idx, class FROM r JOIN dim ON dim.idx = r.i WHERE rn = 1",
    "legal_scores": _SCORES + "SELECT game, ply, row_number() OVER (PARTITION BY game, ply ORDER BY score DESC, a) - 1 AS rank, notation, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY game, ply), 6) AS share FROM sc",
    "legal_alternatives": _SCORES + "SELECT game, ply, row_number() OVER (PARTITION BY game, ply ORDER BY round(own, 4) DESC, notation) - 1 AS rank, notation, round(own, 4) AS p FROM sc",
    "evidence_logp": GAMES_SQL
    + """, zz AS (SELECT vec_id, c AS i, 8.0::DOUBLE * embedding[c % 64 + 1]::DOUBLE + ((c * 37 + vec_id * 11) % 101)::DOUBLE / 50.0::DOUBLE AS z FROM embeddings, range(85) r(c)),
    ee AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM zz), pp AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ee),
    tot AS (SELECT vec_id, sum(p) FILTER (WHERE i BETWEEN 10 AND 81) AS kz, sum(p) FILTER (WHERE i < 84) AS pt FROM pp GROUP BY vec_id),
    ob AS (SELECT user_id, ply, k, (user_id * 13 + ply + k) % (SELECT count(*) FROM embeddings) AS vec_id, CASE WHEN k = 18 THEN k0 WHEN k = 19 THEN k1 ELSE pits[k + 1] END AS n,
           k < 18 AND CASE WHEN k // 9 = 1 THEN t0 ELSE t1 END = k % 9 AS owned FROM plies, range(20) r(k) WHERE ply % 20 = 0),
    ch AS (SELECT o.user_id, o.ply, o.k, CASE WHEN o.n > 81 THEN 0 WHEN o.k >= 18 THEN CASE WHEN o.n BETWEEN 10 AND 81 THEN a.p / t.kz ELSE 0 END
           WHEN o.owned THEN x.p / t.pt WHEN o.n = 0 THEN (d.p + a.p) / t.pt ELSE a.p / t.pt END AS c
           FROM ob o JOIN tot t USING (vec_id) LEFT JOIN pp a ON a.vec_id = o.vec_id AND a.i = o.n JOIN pp x ON x.vec_id = o.vec_id AND x.i = 82 JOIN pp d ON d.vec_id = o.vec_id AND d.i = 83)
    SELECT user_id, ply, round(sum(CASE WHEN k >= 18 THEN ln(greatest(c, 1e-4)) ELSE 0.5 * ln(greatest(c, 1e-3)) END), 6) AS logp FROM ch GROUP BY user_id, ply""",
    "beam_cap": "SELECT p_partkey AS k, p_partkey * 37 - 500 AS asked, p_size % 12 AS per_ply, greatest(1, least(p_partkey * 37 - 500, 2147483648 // (25000 * greatest(p_size % 12, 1)))) AS width FROM part",
}
