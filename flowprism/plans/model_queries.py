"""Registered queries: splits, scaling, kernels, neighbours, kINN, thresholds, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.functions import kernels as K
from flowprism.functions import labels as L
from flowprism.operators import baselines, experiments, kinn, lof, scaling, threshold
from flowprism.operators import neighbours as N
from flowprism.operators.aggregates import label_counts
from flowprism.operators.split import decode_labels, encode_labels, fit_labels, stratified_split
from flowprism.plans.packet_queries import _LABELLED as LABELLED
from flowprism.plans.packet_queries import LABEL_SQL, WITH, R, ip_arp, labelled, tidy
from flowprism.plans.registry import query, table
from flowprism.plans.sweep_sql import sweep_sql
from flowprism.session import durable

STEPS = 5
# Step counts of the sweep: that of the other queries and the default of a run.
SWEEP_STEPS = (STEPS, 100)
DIGITS = 6
# Rows per block where a query is to prune cells on small tables.
SMALL_BLOCK = 32
SHARE = 0.3
DIM = 64

# ---- split and codes ------------------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("vector")
    )


def split_rows(spark, sf) -> DataFrame:
    key = F.pmod(F.col("id") * F.lit(2654435761) + 42, F.lit(1 << 32))
    return stratified_split(vectors(spark, sf), "class", "id", SHARE, key=key)


def train_test(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = durable(split_rows(spark, sf))
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


SPLIT = f"""v as (select vec_id as id, label as class, cast(embedding as double[]) as x from embeddings),
 split as (select *, row_number() over (partition by class order by (id * 2654435761 + 42) % 4294967296, id)
     <= round({SHARE} * count(*) over (partition by class)) as is_test from v),
 train as (select * from split where not is_test), test as (select * from split where is_test)"""


@query("stratified_split", f"with {SPLIT} select id, cast(class as bigint) as class, cast(is_test as bigint) as is_test from split")
def stratified(spark, sf):
    return tidy(split_rows(spark, sf).select("id", "class", "is_test"))


_CODES = "codes as (select label, row_number() over (order by label) - 1 as code from (select distinct label from labelled) d)"


@query("label_encode", f"{LABELLED}, {_CODES} select l.seq, l.label, c.code from labelled l join codes c on l.label = c.label")
def label_encode(spark, sf):
    rows = labelled(spark, sf)
    return tidy(encode_labels(rows, fit_labels(rows)).select("seq", "label", "code"))


@query("label_decode", f"{LABELLED} select seq, label from labelled")
def label_decode(spark, sf):
    rows = labelled(spark, sf)
    encoder = fit_labels(rows)
    coded = encode_labels(rows, encoder).select("seq", "code")
    return decode_labels(coded, encoder).select("seq", "label")


# ---- scaling --------------------------------------------------------------------------

_LONG = "l as (select id, unnest(generate_series(0, len(x) - 1)) as pos, unnest(x) as value from {0})"
_FITTED = {
    "standard": ("avg(value)", "stddev_pop(value)"),
    "minmax": ("min(value)", "max(value) - min(value)"),
    "robust": ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
}


def _scale_sql(kind: str, fitted: str, applied: str) -> str:
    center, spread = _FITTED[kind]
    return f"""with {SPLIT}, {_LONG.format(applied)}, f as (select unnest(generate_series(0, len(x) - 1)) as pos, unnest(x) as value from {fitted}),
    s as (select pos, {center} as c, {spread} as w from f group by pos)
    select l.id, cast(l.pos as bigint) as pos, {R("(value - c) / case when w = 0 then 1 else w end")} as value from l join s on l.pos = s.pos"""


def _scaled(rows: DataFrame, fitted: DataFrame, kind: str) -> DataFrame:
    out = scaling.fit_scaler(fitted, kind).transform(rows.select("id", "vector"))
    return tidy(out.select("id", F.posexplode("vector").alias("pos", "value")))


def _scale_query(kind: str) -> None:
    @query(f"scale_{kind}", _scale_sql(kind, "v", "v"))
    def scaled(spark, sf):
        rows = vectors(spark, sf)
        return _scaled(rows, rows, kind)


for _kind in _FITTED:
    _scale_query(_kind)


@query("scale_apply", _scale_sql("standard", "train", "split"))
def scale_apply(spark, sf):
    rows = durable(split_rows(spark, sf))
    return _scaled(rows, rows.where(~F.col("is_test")), "standard")


@query(
    "scale_l2",
    f"""with {SPLIT}, n as (select id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) as norm from v)
    select id, unnest(generate_series(0, len(x) - 1)) as pos,
      unnest(list_transform(x, lambda a: round(a / case when norm = 0 then 1 else norm end + 1e-9, 6) + 0.0)) as value from n""",
)
def scale_l2(spark, sf):
    rows = vectors(spark, sf)
    return _scaled(rows, rows, "l2")


def _poly(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def _probit_sql(p: str) -> str:
    tail = "(case when {p} < 0.5 then {s} else -({s}) end)"
    q = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{_poly(scaling.PROBIT_C, q)} / ({_poly(scaling.PROBIT_D, q)} * {q} + 1)"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    inner = f"{_poly(scaling.PROBIT_A, r)} * ({p} - 0.5) / ({_poly(scaling.PROBIT_B, r)} * {r} + 1)"
    return f"case when least({p}, 1 - {p}) < {scaling.PROBIT_LOW} then {tail.format(p=p, s=outer)} else {inner} end"


@query(
    "scale_quantile_normal",
    f"""with {SPLIT}, {_LONG.format("v")}, m as (select least(1000, count(*)) as points from v),
    g as (select k, k / (points - 1.0) as p from m, unnest(generate_series(0, points - 1)) as u(k)),
    lists as (select pos, list(value order by value) as s, count(*) as n from l group by pos),
    q as (select pos, g.k, g.p, s[cast(floor(g.p * (n - 1)) as bigint) + 1]
         + (s[cast(ceil(g.p * (n - 1)) as bigint) + 1] - s[cast(floor(g.p * (n - 1)) as bigint) + 1]) * (g.p * (n - 1) - floor(g.p * (n - 1))) as v
       from lists join g on true),
    qv as (select pos, v, min(p) as p_lo, max(p) as p_hi from q group by pos, v),
    q2 as (select *, lead(v) over (partition by pos order by v) as v2, lead(p_lo) over (partition by pos order by v) as p2 from qv),
    placed as (select l.id, l.pos, case when q2.v2 is null then q2.p_hi when l.value = q2.v then case when q2.p_lo = 0 then 0 else (q2.p_lo + q2.p_hi) / 2 end
         else q2.p_hi + (q2.p2 - q2.p_hi) * (l.value - q2.v) / (q2.v2 - q2.v) end as p
       from l asof join q2 on l.pos = q2.pos and l.value >= q2.v),
    clipped as (select id, pos, least(greatest(p, 1e-7), 1 - 1e-7) as p from placed)
    select id, cast(pos as bigint) as pos, {R(_probit_sql("p"), 5)} as value from clipped""",
)
def scale_quantile_normal(spark, sf):
    rows = vectors(spark, sf)
    out = scaling.fit_scaler(rows, "quantile_normal").transform(rows.select("id", "vector"))
    return tidy(out.select("id", F.posexplode("vector").alias("pos", "value")), {"value": 5})


# ---- kernels --------------------------------------------------------------------------

# Each vector against the first vector of its class: one pair per row.
_ANCHORED = f"with {SPLIT}, p as (select v.id, v.x, a.x as y from v join v a on a.id = (select min(id) from v b where b.class = v.class))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_SQ = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _kernel_sql(name: str, x: str, y: str) -> str:
    return {
        "linear": _DOT.format(x, y),
        "poly": f"pow({_DOT.format(x, y)} / {DIM} + 1, 3)",
        "rbf": f"exp(-{_SQ.format(x, y)} / {DIM})",
        "sigmoid": f"tanh({_DOT.format(x, y)} / {DIM} + 1)",
    }[name]


def anchored(spark, sf) -> DataFrame:
    rows = vectors(spark, sf)
    anchors = rows.groupBy("class").agg(F.min_by("vector", "id").alias("anchor"))
    return rows.join(anchors, "class")


def _kernel_query(name: str) -> None:
    @query(f"kernel_{name}", f"{_ANCHORED} select id, {R(_kernel_sql(name, 'x', 'y'))} as k from p")
    def kernel(spark, sf):
        return tidy(anchored(spark, sf).select("id", K.kernel(F.col("vector"), F.col("anchor"), name).alias("k")))


for _name in K.KERNELS:
    _kernel_query(_name)


def _distance_sql(name: str) -> str:
    if name == "euclidean":
        return f"sqrt({_SQ.format('x', 'y')})"
    return f"{_kernel_sql(name, 'x', 'x')} - 2 * {_kernel_sql(name, 'x', 'y')} + {_kernel_sql(name, 'y', 'y')}"


@query(
    "kernel_distance",
    f"{_ANCHORED} select id, " + ", ".join(f"{R(_distance_sql(n))} as {n}" for n in (*K.KERNELS, "euclidean")) + " from p",
)
def kernel_distance(spark, sf):
    pairs = anchored(spark, sf)
    x, y = F.col("vector"), F.col("anchor")
    return tidy(pairs.select("id", *[K.kernel_distance(x, y, n).alias(n) for n in (*K.KERNELS, "euclidean")]))


# ---- neighbour lists ------------------------------------------------------------------


def _pair_distance(kernel: str) -> str:
    """Distance of vectors a.x and b.x in the oracle."""
    square = _SQ.format("a.x", "b.x")
    return {"linear": square, "euclidean": f"sqrt({square})", "rbf": f"2 - 2 * exp(-{square} / {DIM})"}[kernel]


def _lists(pairs: str, name: str, d: str = "d") -> str:
    """CTE with the step walk over ``pairs(i, j, d)``."""
    return f"""{name}_w as (select i, j, round({d}, {DIGITS}) as d from {pairs}),
    {name}_s as (select *, abs(d - coalesce(lag(d) over (partition by i order by d, j), 0)) > 5e-7 as is_step from {name}_w),
    {name}_c as (select *, sum(cast(is_step as int)) over (partition by i order by d, j rows unbounded preceding) as step from {name}_s),
    {name} as (select *, row_number() over (partition by i order by d, j) as pos from {name}_c where step < {STEPS} or (step = {STEPS} and is_step))"""


def _fit_sql(kernel: str, source: str = "train") -> str:
    return f"""with recursive {SPLIT}, pairs as (select a.id as i, b.id as j,
      case when a.id = b.id then 0 else {_pair_distance(kernel)} end as d
      from {source} a join {source} b on a.class = b.class), {_lists("pairs", "lists")}"""


_DENSITY = f"""kd as (select i, coalesce(max(d) filter (where is_step), -1) as k from lists group by i),
    lrd as (select l.i, 1 / nullif(avg(greatest(l.d, kd.k)), 0) as lrd from lists l join kd on kd.i = l.j group by l.i),
    lof as (select l.i, coalesce(avg(n.lrd) / any_value(m.lrd), 1) as lof from lists l join lrd n on n.i = l.j join lrd m on m.i = l.i group by l.i),
    weighted as (select p.i, p.j, p.d * lof.lof as d from pairs p join lof on lof.i = p.j), {_lists("weighted", "dense")}"""


def class_lists(spark, sf, kernel: str) -> DataFrame:
    train, _ = train_test(spark, sf)
    return kinn.fit_lists(kinn.distinct_nodes(train), STEPS, kernel, digits=DIGITS)


_OUT = f"i, j, {R('d')} as d, cast(pos as bigint) as pos"


@query("knn_rank", f"{_fit_sql('linear')} select {_OUT} from lists")
def knn_rank(spark, sf):
    return tidy(class_lists(spark, sf, "linear").select("i", "j", "d", "pos"))


@query("knn_rank_blocks", f"{_fit_sql('linear')} select {_OUT} from lists")
def knn_rank_blocks(spark, sf):
    """The same lists with blocks so small that cells are pruned."""
    train, _ = train_test(spark, sf)
    lists = kinn.fit_lists(kinn.distinct_nodes(train), STEPS, "linear", digits=DIGITS, block_rows=SMALL_BLOCK)
    return tidy(lists.select("i", "j", "d", "pos"))


@query("k_distance", f"{_fit_sql('linear')} select i, {R('coalesce(max(d) filter (where is_step), -1)')} as k_distance from lists group by i")
def k_distance(spark, sf):
    return tidy(N.k_distance(class_lists(spark, sf, "linear")))


@query("kinn_fit_distance", f"{_fit_sql('rbf')} select {_OUT} from lists")
def kinn_fit_distance(spark, sf):
    return tidy(class_lists(spark, sf, "rbf").select("i", "j", "d", "pos"))


@query("kinn_fit_density", f"{_fit_sql('euclidean')}, {_DENSITY} select {_OUT} from dense")
def kinn_fit_density(spark, sf):
    train, _ = train_test(spark, sf)
    lists = kinn.fit_lists(kinn.distinct_nodes(train), STEPS, "euclidean", "density", digits=DIGITS)
    return tidy(lists.select("i", "j", "d", "pos"))


@query("kinn_fit_density_blocks", f"{_fit_sql('euclidean')}, {_DENSITY} select {_OUT} from dense")
def kinn_fit_density_blocks(spark, sf):
    train, _ = train_test(spark, sf)
    lists = kinn.fit_lists(kinn.distinct_nodes(train), STEPS, "euclidean", "density", digits=DIGITS, block_rows=SMALL_BLOCK)
    return tidy(lists.select("i", "j", "d", "pos"))


_NEAREST_OTHER = """select i, j, {d} as d, pos from (select a.id as i, b.id as j, round({pair}, 6) as d,
  row_number() over (partition by a.id order by round({pair}, 6), b.id) as pos
  from v a join v b on a.class = b.class and a.id <> b.id) x where pos <= 5"""


@query("kernel_pairs", f"with {SPLIT} " + _NEAREST_OTHER.format(d=R("d"), pair=_pair_distance("euclidean")))
def kernel_pairs(spark, sf):
    """Pairs inside a class, kept down to each vector's five closest others."""
    rows = vectors(spark, sf).withColumnRenamed("class", "grp")
    lists = N.neighbours(rows, rows, 5, kernel="euclidean", levels=False, digits=DIGITS)
    return tidy(lists.select("i", "j", "d", "pos"))


def _test_sql(kernel: str, source: str = "train") -> str:
    return f"""tp as (select a.id as i, b.id as j, b.class as class, round({_pair_distance(kernel)}, {DIGITS}) as d from test a join {source} b on true),
    ranked as (select *, row_number() over (partition by i order by d, j) as pos from tp)"""


def test_neighbours(spark, sf, k: int, kernel: str) -> DataFrame:
    train, test = train_test(spark, sf)
    one = F.lit(0).alias("grp")
    return N.neighbours(
        test.select(one, "id", "vector"), train.select(one, "id", "vector"), k,
        kernel=kernel, levels=False, same=False, digits=DIGITS,
    )


@query("test_train_pairs", f"with {SPLIT}, {_test_sql('rbf')} select {_OUT} from ranked where pos <= 3")
def test_train_pairs(spark, sf):
    """Test against train rows, kept down to the three closest per test row."""
    return tidy(test_neighbours(spark, sf, 3, "rbf").select("i", "j", "d", "pos"))


@query("topk_neighbours", f"with {SPLIT}, {_test_sql('linear')} select {_OUT} from ranked where pos <= {STEPS}")
def topk_neighbours(spark, sf):
    return tidy(test_neighbours(spark, sf, STEPS, "linear").select("i", "j", "d", "pos"))


@query("nearest_one", f"with {SPLIT}, {_test_sql('linear')} select i, j, {R('d')} as d from ranked where pos = 1")
def nearest_one(spark, sf):
    return tidy(N.nearest_one(test_neighbours(spark, sf, 1, "linear")))


# ---- kINN -----------------------------------------------------------------------------

_EDGES = "edges as (select a.i, a.j from lists a join lists b on a.i = b.j and a.j = b.i)"
_ROOTS = f"""{_EDGES}, reach(i, j) as (select id, id from train union select r.i, e.j from reach r join edges e on e.i = r.j),
    roots as (select i as id, min(j) as root from reach group by i),
    clusters as (select id, dense_rank() over (order by root) - 1 as cluster from roots)"""
_CLUSTER_MAP = "cmap as (select c.cluster, arg_min(t.class, t.id) as class from clusters c join train t on t.id = c.id group by c.cluster)"


def fitted(spark, sf, kernel: str = "rbf", train: DataFrame | None = None) -> kinn.Kinn:
    if train is None:
        train, _ = train_test(spark, sf)
    return kinn.fit(train, STEPS, kernel=kernel, digits=DIGITS)


@query("mutual_nn_join", f"{_fit_sql('linear')}, {_EDGES} select i, j from edges")
def mutual_nn_join(spark, sf):
    return kinn.mutual_edges(durable(class_lists(spark, sf, "linear")))


@query("inn_graph", f"{_fit_sql('rbf')}, {_EDGES} select i, count(*) as degree, min(j) as first from edges group by i")
def inn_graph(spark, sf):
    edges = kinn.mutual_edges(durable(class_lists(spark, sf, "rbf")))
    return edges.groupBy("i").agg(F.count(F.lit(1)).alias("degree"), F.min("j").alias("first"))


@query("inn_components", f"{_fit_sql('rbf')}, {_ROOTS} select id, cast(cluster as bigint) as cluster from clusters")
def inn_components(spark, sf):
    return fitted(spark, sf).clusters


@query("cluster_class_map", f"{_fit_sql('rbf')}, {_ROOTS}, {_CLUSTER_MAP} select cast(cluster as bigint) as cluster, cast(class as bigint) as class, cast(0 as bigint) as conflicts from cmap")
def cluster_class_map(spark, sf):
    return tidy(fitted(spark, sf).cluster_map)


@query("cluster_sizes", f"{_fit_sql('rbf')}, {_ROOTS}, {_CLUSTER_MAP} select cast(class as bigint) as class, count(*) as n from cmap group by class")
def cluster_sizes(spark, sf):
    return tidy(label_counts(fitted(spark, sf).cluster_map, "class"))


@query(
    "neighbours_of",
    f"{_fit_sql('rbf')}, me as (select min(id) as id from train) select i, j, {R('d')} as d, row_number() over (order by d, j) as pos from lists where i = (select id from me) and j <> i",
)
def neighbours_of(spark, sf):
    model = fitted(spark, sf)
    me = model.nodes.agg(F.min("id")).first()[0]
    return tidy(kinn.neighbours_of(model, me))


_INN_CHECK = f"""tr as (select id, row_number() over (order by class, id) - 1 as at from train),
    te as (select id, row_number() over (order by id) - 1 as at from test),
    checked as (select r.i, r.j, r.d from ranked r join te on te.id = r.i join tr on tr.at = te.at
      join lists l on l.i = r.j and l.j = tr.id where r.pos <= {STEPS})"""


@query("test_inn_check", f"{_fit_sql('rbf')}, {_test_sql('rbf')}, {_INN_CHECK} select i, j, {R('d')} as d from checked")
def test_inn_check(spark, sf):
    train, test = train_test(spark, sf)
    model = fitted(spark, sf, train=train)
    ranked = durable(kinn.test_lists(model, test, STEPS))
    return tidy(kinn.inn_check(kinn.first_points(ranked, model, STEPS), model, test))


_CHOSEN = "chosen as (select n.i, coalesce((select arg_min(c.j, [c.d, c.j]) from checked c where c.i = n.i), n.j) as j from ranked n where n.pos = 1)"


@query(
    "kinn_predict_supervised",
    f"{_fit_sql('rbf')}, {_ROOTS}, {_CLUSTER_MAP}, {_test_sql('rbf')}, {_INN_CHECK}, {_CHOSEN} "
    "select h.i as id, cast(m.class as bigint) as pred from chosen h join clusters c on c.id = h.j join cmap m on m.cluster = c.cluster",
)
def kinn_predict_supervised(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(kinn.predict_supervised(fitted(spark, sf, train=train), test))


@query(
    "kinn_predict_supervised_blocks",
    f"{_fit_sql('rbf')}, {_ROOTS}, {_CLUSTER_MAP}, {_test_sql('rbf')}, {_INN_CHECK}, {_CHOSEN} "
    "select h.i as id, cast(m.class as bigint) as pred from chosen h join clusters c on c.id = h.j join cmap m on m.cluster = c.cluster",
)
def kinn_predict_supervised_blocks(spark, sf):
    train, test = train_test(spark, sf)
    model = kinn.fit(train, STEPS, kernel="rbf", digits=DIGITS, block_rows=SMALL_BLOCK)
    return tidy(kinn.predict_supervised(model, test, block_rows=SMALL_BLOCK))


@query(
    "kinn_predict_supervised_nearest",
    f"with {SPLIT}, {_test_sql('rbf')} select i as id, cast(class as bigint) as pred from ranked where pos = 1",
)
def kinn_predict_supervised_nearest(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(kinn.predict_supervised(fitted(spark, sf, train=train), test, compat="nearest"))


# ---- thresholds -----------------------------------------------------------------------

_GRID = f"grid as (select k, {threshold.LOW} + k * ({threshold.HIGH} - {threshold.LOW}) / {threshold.STEPS - 1} as x from generate_series(0, {threshold.STEPS - 1}) as t(k))"


def _search_sql(classes: list[int], target: int) -> str:
    """The class-by-class search over ``scored(truth, pred, score)`` as chained CTEs."""
    parts = [
        _GRID,
        f"""st0 as (select cast(count(*) filter (where truth = pred) as double) as rgt, cast(count(*) filter (where truth = pred and pred = {target}) as double) as caught,
         cast(count(*) filter (where pred = {target}) as double) as pt_n, cast(count(*) as double) as s, 0.0::double as mcc, 0.0::double as ndr from scored)""",
        """tc as (select truth as c, cast(count(*) as double) as n from scored group by truth)""",
        """pc as (select pred as c, cast(count(*) as double) as n from scored group by pred)""",
        """sums as (select (select sum(n * n) from tc) as tt, (select coalesce(sum(tc.n * pc.n), 0) from tc join pc on tc.c = pc.c) as pt, (select sum(n * n) from pc) as pp)""",
        "st00 as (select st0.*, pt, pp, tt from st0, sums)",
    ]
    before = "st00"
    for position, i in enumerate(classes):
        moved = f"""cu{position} as (select score, sum(n) over w as n, sum(own) over w as own, sum(nov) over w as nov from (
            select score, count(*) as n, count(*) filter (where truth = {i}) as own, count(*) filter (where truth = {target}) as nov
            from scored where pred = {i} group by score) z window w as (order by score desc rows unbounded preceding))"""
        at = f"""at{position} as (select g.k, g.x, coalesce(c.n, 0) as n, coalesce(c.own, 0) as own, coalesce(c.nov, 0) as nov
            from grid g asof left join cu{position} c on g.x < c.score)"""
        truth = "coalesce((select n from tc where c = {0}), 0)"
        pred = f"coalesce((select n from pc where c = {i}), 0)"
        new = f"""nw{position} as (select a.k, a.x, s.s, s.tt, s.rgt - a.own + a.nov as rgt, s.caught + a.nov as caught, s.pt_n + a.n as pt_n,
            s.pt - a.n * {truth.format(i)} + a.n * {truth.format(target)} as pt,
            s.pp - pow({pred}, 2) + pow({pred} - a.n, 2) - pow(s.pt_n, 2) + pow(s.pt_n + a.n, 2) as pp, s.mcc as mcc0, s.ndr as ndr0
            from at{position} a, {before} s)"""
        scored = f"""sc{position} as (select *, case when s * s - pp > 0 and s * s - tt > 0 then (rgt * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)) else 0 end as mcc,
            caught / nullif({truth.format(target)}, 0) as ndr from nw{position})"""
        best = f"""bs{position} as (select * from sc{position} where (2 * mcc + ndr) / 2 > (2 * mcc0 + ndr0) / 2 order by (2 * mcc + ndr) / 2 desc, k limit 1)"""
        step = f"""st{position + 1} as (select coalesce(b.rgt, s.rgt) as rgt, coalesce(b.caught, s.caught) as caught, coalesce(b.pt_n, s.pt_n) as pt_n, s.s,
            coalesce(b.mcc, s.mcc) as mcc, coalesce(b.ndr, s.ndr) as ndr, coalesce(b.pt, s.pt) as pt, coalesce(b.pp, s.pp) as pp, s.tt,
            coalesce(b.x, -1) as x from {before} s left join bs{position} b on true)"""
        parts += [part.replace(" as (", " as materialized (", 1) for part in (moved, at, new, scored, best, step)]
        before = f"st{position + 1}"
    cuts = " union all ".join(f"select {i} as class, x from st{p + 1}" for p, i in enumerate(classes))
    parts += [f"cuts as ({cuts})", f"final as (select mcc, ndr from {before})"]
    return ", ".join(parts)


_CUTS = f"select cast(class as bigint) as class, {R('x', 8)} as threshold, {R('mcc')} as mcc, {R('ndr')} as ndr from cuts, final where x >= 0"


def _cut_table(spark, found: threshold.Thresholds) -> DataFrame:
    rows = [(int(c), float(x), found.mcc, found.ndr) for c, x in found.thresholds.items()]
    return tidy(spark.createDataFrame(rows, "class bigint, threshold double, mcc double, ndr double"), {"threshold": 8})


_ATTACK_SCORED = f"""scored as (select cast(label <> 'benign' as int) as truth, 0 as pred,
  (seq * 7919 % 10007) / 200140.0::double + case when label <> 'benign' then 0.03 else 0 end as score
  from (select seq, {LABEL_SQL} as label from frames) x)"""


@query("threshold_search", f"{WITH}, {_ATTACK_SCORED}, {_search_sql([0], 1)} {_CUTS}")
def threshold_search(spark, sf):
    """One-class search over every packet: attacks score higher."""
    attack = L.label_mask() != L.BENIGN
    rows = ip_arp(spark, sf).select(
        attack.cast("int").alias("truth"),
        F.lit(0).alias("pred"),
        (F.pmod(F.col("seq") * 7919, F.lit(10007)) / F.lit(200140.0) + F.when(attack, 0.03).otherwise(0.0)).alias("score"),
    )
    return _cut_table(spark, threshold.search(rows, "oneclass"))


_CLASS_CODE = {"ARP": 0, "ICMP": 1, "TCP": 2, "benign": 3}
_CODED = "case label when 'ARP' then 0 when 'ICMP' then 1 when 'TCP' then 2 when 'benign' then 3 else {0} end"
_NOVEL_SCORED = f"""scored as (select {_CODED.format(-1)} as truth, case when seq % 9 = 0 then (seq // 9) % 4 else {_CODED.format("seq % 4")} end as pred,
  (seq * 7919 % 10007) / 200140.0::double + case when label = 'UDP' then 0.02 + 0.005 * (seq % 4) else 0 end as score
  from (select seq, {LABEL_SQL} as label from frames) x)"""


@query("threshold_search_novelty", f"{WITH}, {_NOVEL_SCORED}, {_search_sql([0, 1, 2, 3], -1)} {_CUTS}")
def threshold_search_novelty(spark, sf):
    """UDP scans are the hidden class; the four known classes are searched in turn."""
    rows = ip_arp(spark, sf).withColumn("label", L.label_mask())
    code = F.when(F.col("label") == "UDP", -1)
    for name, number in _CLASS_CODE.items():
        code = code.when(F.col("label") == name, number)
    seq = F.col("seq")
    pred = F.when(seq % 9 == 0, F.floor(seq / 9) % 4).when(F.col("label") == "UDP", seq % 4).otherwise(code)
    extra = F.when(F.col("label") == "UDP", F.lit(0.02) + F.lit(0.005) * (seq % 4)).otherwise(0.0)
    score = F.pmod(seq * 7919, F.lit(10007)) / F.lit(200140.0) + extra
    return _cut_table(
        spark, threshold.search(rows.select(code.alias("truth"), pred.cast("int").alias("pred"), score.alias("score")))
    )


_NOVEL = "case when class = 9 then -1 else class end"


@query(
    "kinn_predict_novelty",
    f"""with {SPLIT}, known as (select * from train where class <> 9), {_test_sql("rbf", "known")},
    near as (select i as id, class as pred, d as score from ranked where pos = 1),
    scored as (select n.id, {_NOVEL.replace("class", "t.class")} as truth, n.pred, n.score from near n join test t on t.id = n.id),
    {_search_sql(list(range(9)), -1)}
    select s.id, cast(case when c.x >= 0 and s.score > c.x then -1 else s.pred end as bigint) as pred, {R("s.score")} as score
    from scored s join cuts c on c.class = s.pred""",
)
def kinn_predict_novelty(spark, sf):
    train, test = train_test(spark, sf)
    model = fitted(spark, sf, train=train.where(F.col("class") != 9))
    truth = test.select("id", F.when(F.col("class") == 9, -1).otherwise(F.col("class")).alias("truth"))
    rows = durable(kinn.predict_scores(model, test).join(truth, "id"))
    return tidy(threshold.apply(rows, threshold.search(rows, "novelty"), "novelty").select("id", "pred", "score"))


@query(
    "kinn_predict_oneclass",
    f"""with {SPLIT}, known as (select * from train where class = 0), {_test_sql("rbf", "known")},
    scored as (select n.i as id, cast(t.class <> 0 as int) as truth, 0 as pred, n.d as score from ranked n join test t on t.id = n.i where n.pos = 1),
    {_search_sql([0], 1)}
    select s.id, cast(case when c.x >= 0 and s.score > c.x then 1 else 0 end as bigint) as pred, {R("s.score")} as score
    from scored s join cuts c on true""",
)
def kinn_predict_oneclass(spark, sf):
    train, test = train_test(spark, sf)
    model = fitted(spark, sf, train=train.where(F.col("class") == 0))
    truth = test.select("id", (F.col("class") != 0).cast("int").alias("truth"))
    rows = durable(kinn.predict_scores(model, test).withColumn("pred", F.lit(0)).join(truth, "id"))
    return tidy(threshold.apply(rows, threshold.search(rows, "oneclass"), "oneclass").select("id", "pred", "score"))


# ---- outliers, baselines, experiments -------------------------------------------------


def _lof_sql(points: str, queries: str, name: str, same: bool) -> str:
    """LOF of ``queries`` among ``points`` (tables with id, grp, x), k = 20."""
    join = "a.grp = b.grp" + (" and a.id <> b.id" if same else "")
    return f"""{name}_p as (select a.id as i, b.id as j, round(sqrt({_SQ.format("a.x", "b.x")}), {DIGITS}) as d from {queries} a join {points} b on {join}),
    {name}_n as (select * from (select *, row_number() over (partition by i order by d, j) as pos from {name}_p) z where pos <= 20)"""


_LOF_OWN = """own_k as (select i, max(d) as k from own_n group by i),
    own_r as (select n.i, 1 / (avg(greatest(n.d, k.k)) + 1e-10) as lrd from own_n n join own_k k on k.i = n.j group by n.i),
    own_l as (select n.i, avg(r.lrd) / any_value(o.lrd) as lof from own_n n join own_r r on r.i = n.j join own_r o on o.i = n.i group by n.i)"""


@query(
    "lof_outlier_filter",
    f"""with {SPLIT}, g as (select id, class as grp, x from v where class <> 0), {_lof_sql("g", "g", "own", True)}, {_LOF_OWN},
    cut as (select g.grp, quantile_cont(-l.lof, 0.05) as q from g join own_l l on l.i = g.id group by g.grp)
    select g.id, cast(g.grp as bigint) as class from g join own_l l on l.i = g.id join cut on cut.grp = g.grp where -l.lof >= q
    union all select id, cast(class as bigint) from v where class = 0""",
)
def lof_outlier_filter(spark, sf):
    rows = vectors(spark, sf).withColumnRenamed("class", "grp")
    return tidy(lof.lof_outlier_filter(rows, 0, digits=DIGITS).select("id", F.col("grp").alias("class")))


@query(
    "oneclass_lof",
    f"""with {SPLIT}, tr as (select id, 0 as grp, x from train where class = 0), te as (select id, 0 as grp, x from test),
    {_lof_sql("tr", "tr", "own", True)}, {_LOF_OWN}, {_lof_sql("tr", "te", "far", False)},
    far_r as (select n.i, 1 / (avg(greatest(n.d, k.k)) + 1e-10) as lrd from far_n n join own_k k on k.i = n.j group by n.i),
    far_l as (select n.i, avg(r.lrd) / any_value(o.lrd) as lof from far_n n join own_r r on r.i = n.j join far_r o on o.i = n.i group by n.i)
    select i as id, cast(lof > (select quantile_cont(lof, 0.9) from own_l) as bigint) as pred from far_l""",
)
def oneclass_lof(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(baselines.oneclass_lof(train.where(F.col("class") == 0), test, digits=DIGITS))


@query(
    "baseline_knn",
    f"""with {SPLIT}, {_test_sql("euclidean")}, votes as (select i, class, count(*) as n from ranked where pos <= 5 group by i, class)
    select i as id, cast(pred as bigint) as pred from (select i, class as pred, row_number() over (partition by i order by n desc, class) as r from votes) z where r = 1""",
)
def baseline_knn(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(baselines.knn_vote(train, test, digits=DIGITS))


def _baseline(name: str, model) -> None:
    @query(name)
    def predicted(spark, sf):
        train, test = train_test(spark, sf)
        return model(train, test)


_baseline("baseline_rf", baselines.random_forest)
_baseline("baseline_gbt", baselines.gradient_boosting)
_baseline("baseline_svm", baselines.linear_svm)


def _oneclass(name: str, model) -> None:
    @query(name)
    def predicted(spark, sf):
        train, test = train_test(spark, sf)
        return model(train.where(F.col("class") == 0), test)


_oneclass("oneclass_iforest", baselines.oneclass_iforest)
_ANGLES = """(select i as id, coalesce(-var_pop(w), 0) as score from (
   select a.i, list_sum(list_transform(list_zip(a.l, b.l), lambda z: z[1] * z[2])) / (a.s * b.s) as w
   from {0} a join {0} b on a.i = b.i and a.j < b.j) z group by i)"""


def _lines(name: str, queries: str, points: str, same: bool) -> str:
    skip = "and a.id <> b.id" if same else ""
    return f"""{name} as (select i, j, l, list_sum(list_transform(l, lambda c: c * c)) as s from (
      select a.id as i, b.id as j, list_transform(list_zip(a.x, b.x), lambda z: z[2] - z[1]) as l,
        row_number() over (partition by a.id order by round(sqrt({_SQ.format("a.x", "b.x")}), {DIGITS}), b.id) as pos
      from {queries} a join {points} b on true {skip}) q where pos <= 5)"""


@query(
    "oneclass_abod",
    f"""with {SPLIT}, tr as (select * from train where class = 0), {_lines("own", "tr", "tr", True)}, {_lines("far", "test", "tr", False)},
    a as {_ANGLES.format("own")}, b as {_ANGLES.format("far")}
    select id, cast(score > (select quantile_cont(score, 0.9) from a) as bigint) as pred from b""",
)
def oneclass_abod(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(baselines.oneclass_abod(train.where(F.col("class") == 0), test, digits=DIGITS))


_LINES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(baselines.draw_lines(200)))


def _sphere_scores(name: str, rows: str) -> str:
    """Mean over the samples of the ratio of the smallest sphere that holds a row, 1 outside all."""
    return f"""{name}_in as (select r.id, c.s, c.ratio, row_number() over (partition by r.id, c.s order by c.radius, c.id) as pos
      from {rows} r join sphere c on {_SQ.format("r.x", "c.x")} <= c.radius),
    {name} as (select r.id, (coalesce(sum(i.ratio), 0) + 200 - count(i.s)) / 200 as score
      from {rows} r left join (select * from {name}_in where pos = 1) i on i.id = r.id group by r.id)"""


@query(
    "oneclass_inne",
    f"""with {SPLIT}, tr as (select * from train where class = 0), line(s, a, b) as (values {_LINES}),
    keyed as (select id, x, cast(concat('0x', substring(md5(cast(id as varchar)), 1, 8)) as bigint) % {baselines.PRIME} as h from tr),
    drawn as (select * from (select s, id, x, row_number() over (partition by s order by (h * a + b) % {baselines.PRIME}, id) as r
      from keyed join line on true) z where r <= 8),
    gap as (select a.s, a.id, a.x, b.id as other, {_SQ.format("a.x", "b.x")} as g from drawn a join drawn b on a.s = b.s and a.id <> b.id),
    near as (select s, id, x, other, g as radius from (select *, row_number() over (partition by s, id order by g, other) as pos from gap) z where pos = 1),
    sphere as (select n.s, n.id, n.x, n.radius, case when n.radius = 0 then 0 else 1 - o.radius / n.radius end as ratio
      from near n join near o on o.s = n.s and o.id = n.other),
    {_sphere_scores("own", "tr")}, {_sphere_scores("far", "test")}
    select id, cast(round(score, 9) > round((select quantile_cont(score, 0.9) from own), 9) as bigint) as pred from far""",
)
def oneclass_inne(spark, sf):
    train, test = train_test(spark, sf)
    return tidy(baselines.oneclass_inne(train.where(F.col("class") == 0), test))


@query("baseline_compare")
def baseline_compare(spark, sf):
    train, test = train_test(spark, sf)
    rows = test.select("id", F.col("class").alias("truth"), "vector")
    return baselines.compare(train, rows).drop("seconds")


@query("oneclass_compare")
def oneclass_compare(spark, sf):
    train, test = train_test(spark, sf)
    rows = test.select("id", (F.col("class") != 0).cast("int").alias("truth"), "vector")
    return baselines.oneclass_compare(train.where(F.col("class") == 0), rows)


@query("experiment_sweep", sweep_sql(SPLIT, _probit_sql("p"), R, (*K.KERNELS, "euclidean"), SWEEP_STEPS, DIGITS))
def experiment_sweep(spark, sf):
    """The whole grid; a threshold map is told as ``class:step of the grid``."""
    named = F.when(F.col("class") == 0, L.NORMAL).otherwise(F.concat(F.lit("class_"), F.col("class").cast("string")))
    rows = vectors(spark, sf).select("id", named.alias("label"), "vector")
    key = F.pmod(F.col("id") * F.lit(2654435761) + 42, F.lit(1 << 32))
    runs = [("supervised", []), ("oneclass", []), ("novelty", ["class_9"])]
    out = experiments.sweep(rows, runs, kernels=(*K.KERNELS, "euclidean"), scalers=scaling.KINDS, steps=SWEEP_STEPS, key=key, digits=DIGITS)
    entries = F.transform(
        F.array_sort(F.map_entries("threshold")),
        lambda t: F.concat_ws(":", t["key"].cast("string"), F.round((t["value"] - threshold.LOW) * ((threshold.STEPS - 1) / (threshold.HIGH - threshold.LOW))).cast("int").cast("string")),
    )
    return tidy(out.withColumn("thresholds", F.array_join(entries, ",")).drop("seed", "drop_cls", "threshold"))
