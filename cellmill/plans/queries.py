"""Queries over the derived container, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import mapping as M
from ..functions import names as N
from ..functions import values as X
from ..operators import joins as J
from ..operators import layout as L
from ..operators import multimodal as MM
from ..operators import spatial as S
from ..operators import verify as V
from ..operators.order import chunk_of, islands, positions, running_sum
from ..streaming.arrivals import sessions, windowed_spots
from .derive import CTE, coo, obs, table, var

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"with {CTE}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().removeprefix(',')}" if base else sql
        return f

    return add


def long(c: str | F.Column):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- layouts -----------------------------------------------------------------------------------------------------


@query("select obs_idx, var_idx, value from coo")
def q_coo_counts(spark, d):
    return coo(spark, d)


_PACKED = """, r as (select obs_idx, count(value) as nnz, coalesce(list(var_idx order by var_idx) filter (value is not null), []) as indices, coalesce(list(value order by var_idx) filter (value is not null), []) as vals
  from obs left join coo using (obs_idx) group by obs_idx)"""


@query(_PACKED + " select obs_idx, nnz::bigint as nnz, indices, vals, (sum(nnz) over (order by obs_idx))::bigint as ptr from r")
def q_csr_pack(spark, d):
    return L.pack(coo(spark, d), obs(spark, d))


@query("select obs_idx, var_idx, value from coo")
def q_csr_unpack(spark, d):
    return L.unpack(L.pack(coo(spark, d), obs(spark, d)))


@query(""", r as (select var_idx, count(value) as nnz, coalesce(list(obs_idx order by obs_idx) filter (value is not null), []) as indices, coalesce(list(value order by obs_idx) filter (value is not null), []) as vals
  from var left join coo using (var_idx) group by var_idx) select var_idx, nnz::bigint as nnz, indices, vals, (sum(nnz) over (order by var_idx))::bigint as ptr from r""")
def q_csc_pack(spark, d):
    return L.pack(coo(spark, d), var(spark, d), "var_idx", "obs_idx")


@query(""", s as (select var_idx, obs_idx // 16 as part, count(*) as nnz, list(obs_idx order by obs_idx) as indices, list(value order by obs_idx) as vals from coo group by 1, 2)
select var_idx, part::bigint as part, nnz::bigint as nnz, indices, vals, (sum(nnz) over (order by var_idx, part))::bigint as ptr from s""")
def q_csc_segments(spark, d):
    return L.pack_segments(coo(spark, d), "var_idx", "obs_idx", 16)


@query("select var_idx as obs_idx, obs_idx as var_idx, value from coo")
def q_transpose(spark, d):
    return L.transpose(coo(spark, d))


@query("select o.obs_idx, v.var_idx, coalesce(value, 0)::bigint as value from (select obs_idx from obs where obs_idx between 5 and 24) o cross join (select var_idx from var where var_idx between 10 and 59) v left join coo using (obs_idx, var_idx)")
def q_dense_tile(spark, d):
    return L.dense_tile(coo(spark, d), (5, 25), (10, 60), (obs(spark, d).count(), var(spark, d).count()))


@query("select obs_idx, var_idx, value from coo where obs_idx between 5 and 24 and var_idx between 10 and 59")
def q_dense_to_sparse(spark, d):
    return L.drop_zeros(L.dense_tile(coo(spark, d), (5, 25), (10, 60), (obs(spark, d).count(), var(spark, d).count())))


@query(""", n as (select obs_idx, count(value) as nnz from obs left join coo using (obs_idx) group by 1), p as (select obs_idx, sum(nnz) over (order by obs_idx) as ptr from n)
select obs_idx, (ptr - coalesce(lag(ptr) over (order by obs_idx), 0))::bigint as run from p""")
def q_indptr_diff(spark, d):
    packed = L.pack(coo(spark, d), obs(spark, d)).select("obs_idx", "ptr")
    before = packed.select((F.col("obs_idx") + 1).alias("obs_idx"), F.col("ptr").alias("was"))
    return packed.join(before, "obs_idx", "left").select("obs_idx", long(F.col("ptr") - F.coalesce("was", F.lit(0))).alias("run"))


@query("select (select count(*) from obs)::bigint as n_obs, (select count(*) from var)::bigint as n_var, count(*)::bigint as nnz, round(1 - count(*) / ((select count(*) from obs)::double * (select count(*) from var)), 9) as sparsity from coo")
def q_sparsity(spark, d):
    return V.sparsity(coo(spark, d), obs(spark, d), var(spark, d))


@query("select count(*)::bigint as nnz, count(*)::bigint as last_ptr, true as consistent from coo")
def q_nnz_check(spark, d):
    return V.pointer_check(L.pack(coo(spark, d), obs(spark, d)))


@query("select obs_idx, var_idx, round(ln(1 + value / sum(value) over (partition by obs_idx) * 1e4), 6) as value from coo")
def q_lognorm(spark, d):
    return L.log_normalise(coo(spark, d))


@query("select obs_idx, sum(value)::bigint as total, count(*)::bigint as nnz from coo group by 1")
def q_row_totals(spark, d):
    return coo(spark, d).groupBy("obs_idx").agg(long(F.sum("value")).alias("total"), long(F.count("*")).alias("nnz"))


@query("select max(obs_idx) + 1 as n_rows, max(var_idx) + 1 as n_cols from coo")
def q_infer_dims(spark, d):
    return V.inferred_dims(coo(spark, d))


@query("select (var_idx // 512)::bigint as chunk, count(*)::bigint as nnz, min(var_idx) as first_idx, max(var_idx) as last_idx from coo group by 1")
def q_zarr_chunk_ids(spark, d):
    return coo(spark, d).groupBy(chunk_of(F.col("var_idx"), 512).alias("chunk")).agg(long(F.count("*")).alias("nnz"), F.min("var_idx").alias("first_idx"), F.max("var_idx").alias("last_idx"))


# --- encodings ---------------------------------------------------------------------------------------------------

_LEVELS = "lv as (select label, row_number() over (order by label) - 1 as code from (select distinct c_mktsegment as label from customer where c_mktsegment is not null))"


@query(f"with {_LEVELS} select c_custkey, coalesce(code, -1)::bigint as code from customer left join lv on c_mktsegment = label", base=False)
def q_cat_encode(spark, d):
    c = table(spark, d, "customer")
    return E.encode(c, "c_mktsegment", E.levels_of(c, "c_mktsegment")).select("c_custkey", "code")


@query("select c_custkey, c_mktsegment as label from customer", base=False)
def q_cat_decode(spark, d):
    c = table(spark, d, "customer")
    levels = E.levels_of(c, "c_mktsegment")
    return E.decode(E.encode(c, "c_mktsegment", levels), "code", levels).select("c_custkey", "label")


@query(f"with {_LEVELS}, c as (select c_custkey, (c_custkey % 8)::bigint - 1 as code from customer) select c_custkey, c.code, label from c left join lv on c.code = lv.code", base=False)
def q_cat_bad_codes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 8 - 1).alias("code"))
    return E.decode(c, "code", E.levels_of(c, "c_mktsegment")).select("c_custkey", "code", "label")


@query("select 'var_id' as col, count(distinct p_name)::bigint as n, case when count(distinct p_name) <= 127 then 'int8' when count(distinct p_name) <= 255 then 'uint8' when count(distinct p_name) <= 32767 then 'int16' when count(distinct p_name) <= 65535 then 'uint16' else 'int32' end as width from part union all select 'part', count(*), case when count(*) <= 127 then 'int8' when count(*) <= 255 then 'uint8' when count(*) <= 32767 then 'int16' when count(*) <= 65535 then 'uint16' else 'int32' end from part", base=False)
def q_code_width(spark, d):
    p = table(spark, d, "part")
    counts = p.agg(long(F.count_distinct("p_name")).alias("var_id"), long(F.count("*")).alias("part")).unpivot([], ["var_id", "part"], "col", "n")
    return counts.withColumn("width", E.code_width(F.col("n")))


@query("select c_custkey, case when c_custkey % 5 = 0 then null else c_custkey % 5 end::bigint as value from customer", base=False)
def q_codes_to_values(spark, d):
    return table(spark, d, "customer").select("c_custkey", long(E.one_based(F.col("c_custkey") % 5 - 1)).alias("value"))


_FLAG = "case when p_size % 3 = 0 then null else p_size % 3 = 1 end"


@query(f"select p_partkey, coalesce(({_FLAG})::int, 2) as stored, {_FLAG} as flag from part", base=False)
def q_bool_to_int(spark, d):
    flag = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1)
    return table(spark, d, "part").select("p_partkey", E.bool_to_int(flag).alias("stored"), E.int_to_bool(E.bool_to_int(flag)).alias("flag"))


@query("select p_partkey, case when p_size % 4 = 0 then null else p_size end as value from part", base=False)
def q_flatten_nullable(spark, d):
    return table(spark, d, "part").select("p_partkey", E.flatten_nullable(F.col("p_size"), F.col("p_size") % 4 == 0).alias("value"))


# --- names -------------------------------------------------------------------------------------------------------


@query(", n as (select var_idx, var_id, row_number() over (partition by var_id order by var_idx) - 1 as k from var) select var_idx, case when k = 0 then var_id else var_id || '.' || k end as unique_name from n")
def q_make_unique(spark, d):
    return N.make_unique(var(spark, d), "var_id", "var_idx").select("var_idx", "unique_name")


@query(", n as (select var_idx, var_id, row_number() over (partition by var_id order by var_idx) - 1 as k from var) select var_idx, case when k = 0 then var_id else var_id || '.' || k end as unique_name, var_id as orig_var_index, k > 0 as renamed from n where (select count(*) from n where k > 0) > 0")
def q_orig_index(spark, d):
    named = N.make_unique(var(spark, d), "var_id", "var_idx")
    return named.select("var_idx", "unique_name", F.col("var_id").alias("orig_var_index"), (F.col("var_id") != F.col("unique_name")).alias("renamed"))


_RAW = "(p_size || 'n / ' || p_name || ';;' || p_brand || '_')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_RAW}, '[/\\s,;:\\\\]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_SANE = f"case when regexp_matches({_CLEAN}, '^[0-9]') then 'X' || {_CLEAN} else {_CLEAN} end"


def _raw_name():
    return F.concat(F.col("p_size").cast("string"), F.lit("n / "), "p_name", F.lit(";;"), "p_brand", F.lit("_"))


@query(f"select p_partkey, {_SANE} as clean from part", base=False)
def q_sanitize(spark, d):
    return table(spark, d, "part").select("p_partkey", N.sanitize_column(_raw_name()).alias("clean"))


@query("with c as (select p_partkey, replace(p_brand, '#', '_') as name from part), n as (select *, row_number() over (partition by name order by p_partkey) - 1 as k from c) select p_partkey, case when k = 0 then name else name || '__dup' || k end as col from n", base=False)
def q_sanitize_dup(spark, d):
    c = table(spark, d, "part").withColumn("name", F.replace("p_brand", F.lit("#"), F.lit("_")))
    return N.suffix_duplicates(c, "name", "p_partkey", "col").select("p_partkey", "col")


@query("with c as (select p_partkey, replace(replace(p_name, ' ', '_'), '_', '-') as name from part), n as (select *, row_number() over (partition by name order by p_partkey) - 1 as k from c) select p_partkey, case when k = 0 then name else name || '.' || k end as feature from n", base=False)
def q_fix_features(spark, d):
    c = table(spark, d, "part").withColumn("name", N.fix_feature(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return N.make_unique(c, "name", "p_partkey", "feature").select("p_partkey", "feature")


@query("with i as (select distinct event_type || ' img.' || (user_id % 3) || '-' as name from events), c as (select name, regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as s from i) select name, case when s = '' then 'spatial_' when regexp_matches(s, '^[0-9]') then 'X' || s || '_' else s || '_' end as key from c", base=False)
def q_image_keys(spark, d):
    names = table(spark, d, "events").select(F.concat("event_type", F.lit(" img."), (F.col("user_id") % 3).cast("string"), F.lit("-")).alias("name")).distinct()
    return names.withColumn("key", N.image_key(F.col("name")))


def _picked(spark, d, values: list[str], step: int = 1) -> DataFrame:
    """A file for every len(values) parts, with its names in another order each: file, pos, name."""
    n = len(values)
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / n).cast("long").alias("file"), (F.col("p_partkey") % n).alias("pos"))
    return p.withColumn("name", F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col("pos") * step + F.col("file")) % n + 1).cast("int")))


def _picks(values: list[str], step: int = 1) -> str:
    n = len(values)
    return f"o as (select (p_partkey // {n})::bigint as file, (p_partkey % {n})::bigint as pos, [{', '.join(f"'{v}'" for v in values)}][(p_partkey % {n} * {step} + p_partkey // {n}) % {n} + 1] as name from part)"


def _values(values: list[str]) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in enumerate(values))


_OBSM = ["X_pca", "spatial", "pca", "X_umap", "umap", "X_scVI", "X_spatial", "X_pca_harmony", "X_tsne", "X_X_pca", "X_umap.1"]


@query(f"""with {_picks(_OBSM, 3)}, c as (select file, pos, name, case when starts_with(name, 'X_') then substr(name, 3) else name end as clean from o), k as (select * from c where clean <> 'spatial'),
r as (select *, case when exists (select 1 from k e where e.file = k.file and e.clean = k.clean and e.pos < k.pos) then name else clean end as raw from k),
t as (select *, (select count(*) from r e where e.file = r.file and e.raw = r.raw and e.pos < r.pos) as n from r),
s as (select t.*, (select list(q order by q) from range(1, 20) g(q) where not exists (select 1 from r e where e.file = t.file and e.raw = t.raw || '.' || q)) as free from t)
select file, pos, name as key, case when n = 0 then raw else raw || '.' || free[n] end as reduction from s""", base=False)
def q_reduction_plan(spark, d):
    return MM.reduction_plan(_picked(spark, d, _OBSM, 3).withColumnRenamed("name", "key"), ("file",))


_REDS = ["pca", "PCA", "tSNE", "umap", "harmony", "scVI", "mds"]


@query(f"with {_picks(_REDS)} select file, pos, name, case lower(name) when 'pca' then 'PC_' when 'tsne' then 'tSNE_' when 'umap' then 'UMAP_' when 'harmony' then 'harmony_' when 'scvi' then 'scVI_' else upper(name) || '_' end as key from o", base=False)
def q_reduction_keys(spark, d):
    return _picked(spark, d, _REDS).withColumn("key", M.reduction_key(F.col("name")))


_LAYERS = ["counts", "log_normalized", "scaled", "spliced", "data"]


@query(f"with {_picks(_LAYERS)}, i as (select *, case name when 'log_normalized' then 'data' when 'scaled' then 'scale.data' else name end as layer from o) select *, case layer when 'scale.data' then 'scaled' else layer end as stored from i", base=False)
def q_layer_map(spark, d):
    return _picked(spark, d, _LAYERS).withColumn("layer", M.layer_in(F.col("name"))).withColumn("stored", M.layer_out(F.col("layer")))


_GRAPHS = ["connectivities", "distances", "knn", "RNA_snn", "snn"]


@query(f"with {_picks(_GRAPHS)}, g as (select *, case name when 'connectivities' then 'RNA_snn' when 'distances' then 'RNA_nn' else name end as graph from o), b as (select *, case when starts_with(graph, 'RNA_') then substr(graph, 5) else graph end as bare from g) select file, pos, name, graph, case bare when 'snn' then 'connectivities' when 'nn' then 'distances' else bare end as stored from b", base=False)
def q_graph_map(spark, d):
    g = _picked(spark, d, _GRAPHS).withColumn("graph", M.graph_in(F.col("name"), F.lit("RNA")))
    return g.withColumn("stored", M.graph_out(F.col("graph"), F.lit("RNA")))


_ASSAYS = ["RNA", "SCT", "ADT", "Protein", "ATAC", "Peaks", "Custom"]


@query(f"""with {_picks(_ASSAYS, 2)}, k as (select * from o where not (file % 3 = 0 and name = 'RNA')),
m as (select file, pos, name as assay, case name when 'RNA' then 'rna' when 'SCT' then 'rna' when 'ADT' then 'prot' when 'Protein' then 'prot' when 'ATAC' then 'atac' when 'Peaks' then 'atac' else lower(name) end as plain from k),
c as (select *, exists (select 1 from m e where e.file = m.file and e.plain = m.plain and e.pos < m.pos) as later, exists (select 1 from m e where e.file = m.file and e.assay = 'RNA') as has_rna from m)
select file, pos, assay, case when plain = 'rna' then case when assay = 'SCT' and has_rna then 'sct' else 'rna' end when not later then plain when plain = 'prot' then 'prot_' || lower(assay) when lower(assay) = plain then plain || '.1' else lower(assay) end as modality from c""", base=False)
def q_modality_map(spark, d):
    return MM.modalities(_picked(spark, d, _ASSAYS, 2).filter("not (file % 3 = 0 and name = 'RNA')").withColumnRenamed("name", "assay"), ("file",))


_COLS = ["nCount_RNA", "nFeature_RNA", "percent.mt", "seurat_clusters", "orig.ident", "vst.mean", "vst.variable", "batch"]


@query(f"""with {_picks(_COLS)} select file, pos, name, case name when 'nCount_RNA' then 'n_counts' when 'nFeature_RNA' then 'n_genes' when 'percent.mt' then 'percent_mito' when 'seurat_clusters' then 'clusters' else name end as standard,
  case name when 'nCount_RNA' then 'n_counts' when 'nFeature_RNA' then 'n_genes' when 'percent.mt' then 'pct_counts_mt' when 'orig.ident' then 'batch' else name end as direct,
  case name when 'vst.mean' then 'means' when 'vst.variable' then 'highly_variable' else name end as feature from o""", base=False)
def q_standardize(spark, d):
    name = F.col("name")
    return _picked(spark, d, _COLS).withColumns({"standard": M.standard_column(name), "direct": M.standard_column(name, direct=True), "feature": M.standard_column(name, "var")})


_VARM = ["PCs", "LSI", "pca_extra", "ICs"]


@query(f"with {_picks(_VARM)} select file, pos, name, case name when 'PCs' then 'pca' else lower(name) end as reduction, case when name = 'PCs' then 'PCs' else upper(name) end as stored from o", base=False)
def q_loadings_map(spark, d):
    g = _picked(spark, d, _VARM).withColumn("reduction", M.loadings_in(F.col("name")))
    return g.withColumn("stored", M.loadings_out(F.col("reduction")))


# --- selection ---------------------------------------------------------------------------------------------------

_PICK = [7, 3, 3, 41, 0]


@query("select p.new_idx, c.var_idx, c.value from (values (0, 7), (1, 3), (2, 3), (3, 41), (4, 0)) p(new_idx, obs_idx) join coo c using (obs_idx)")
def q_slice_obs(spark, d):
    return J.slice_rows(coo(spark, d), "obs_idx", _PICK)


@query("select p.new_idx as new_obs, q.new_idx as new_var, c.value from (values (0, 7), (1, 3), (2, 3), (3, 41), (4, 0)) p(new_idx, obs_idx) join coo c using (obs_idx) join (select i as new_idx, 3 * i as var_idx from range(0, 30) r(i)) q on q.var_idx = c.var_idx")
def q_slice_both(spark, d):
    rows = J.slice_rows(coo(spark, d), "obs_idx", _PICK).withColumnRenamed("new_idx", "new_obs")
    return J.slice_rows(rows, "var_idx", [3 * i for i in range(30)]).withColumnRenamed("new_idx", "new_var")


@query("with w(name, place) as (values ('Brand#7', 0), ('Brand#3', 2), ('Brand#25', 3)), k as (select p_partkey, p_brand, place from part join w on p_brand = name) select (row_number() over (order by place, p_partkey) - 1)::bigint as pos, p_partkey, p_brand from k", base=False)
def q_select_items(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return J.select_items(p, "p_brand", ["Brand#7", "gone", "Brand#3", "Brand#25"], "p_partkey")


@query(", v as (select obs_idx, row_number() over (order by obs_idx) - 1 as new_idx from obs where s_acctbal > 0) select new_idx, var_idx, value from coo join v using (obs_idx)")
def q_valid_filter(spark, d):
    return J.valid_rows(coo(spark, d), obs(spark, d), "obs_idx", F.col("s_acctbal") > 0)


@query("select var_idx, var_id from var where highly_variable")
def q_hvg(spark, d):
    return var(spark, d).filter("highly_variable").select("var_idx", "var_id")


@query(", f as (select var_idx from var where p_retailprice > 1500) select v.var_idx, f.var_idx is not null as highly_variable, (select count(*) from f)::bigint as n_variable_features from var v left join f using (var_idx)")
def q_hvg_flag(spark, d):
    v = var(spark, d)
    return J.membership(v, v.filter("p_retailprice > 1500"), "var_idx", "highly_variable", "n_variable_features").select("var_idx", "highly_variable", "n_variable_features")


_HV = ["True", "TRUE", "False", "1", "true"]
_HV_NUMBER = "[0, 1, 1.5, -1, 1000]"


@query(f"select var_idx, [{', '.join(f"'{v}'" for v in _HV)}][p_size % 5 + 1] = 'True' as text_flag, {_HV_NUMBER}[p_size % 5 + 1] <> 0 as number_flag, highly_variable as plain_flag from var")
def q_hv_coerce(spark, d):
    at = (F.col("p_size") % 5 + 1).cast("int")
    text, number = F.element_at(F.array(*[F.lit(v) for v in _HV]), at), F.element_at(F.array(*[F.lit(v) for v in (0.0, 1.0, 1.5, -1.0, 1000.0)]), at)
    return var(spark, d).select("var_idx", V.as_flag(text, "string").alias("text_flag"), V.as_flag(number, "double").alias("number_flag"), V.as_flag(F.col("highly_variable"), "boolean").alias("plain_flag"))


@query("select obs_id, grp, s_acctbal from obs where s_acctbal > 1000 and grp like 'N%'")
def q_value_filter(spark, d):
    return J.value_filter(obs(spark, d), "s_acctbal > 1000 and grp like 'N%'", ["obs_id", "grp", "s_acctbal"])


@query("select obs_idx, var_idx, value from coo where obs_idx in (select obs_idx from obs where s_acctbal > 1000)")
def q_soma_query(spark, d):
    return J.semi(coo(spark, d), obs(spark, d).filter("s_acctbal > 1000"), "obs_idx")


# --- joins -------------------------------------------------------------------------------------------------------


@query(", f as (select distinct var_idx from var where brand like '%1') select c.obs_idx, c.var_idx, c.value from coo c join f using (var_idx)")
def q_common_features(spark, d):
    return J.common(coo(spark, d), var(spark, d).filter("brand like '%1'"), "var_idx")


@query(", f as (select var_id, min(var_idx) as var_idx from var group by 1), m as (select f.var_id, v.brand, v.p_retailprice from f join var v using (var_idx)) select v.var_idx, m.brand as first_brand, m.p_retailprice as first_price from var v left join m using (var_id)")
def q_match_first(spark, d):
    v = var(spark, d)
    return J.match_first(v, v.select("var_id", "var_idx", F.col("brand").alias("first_brand"), F.col("p_retailprice").alias("first_price")), "var_id", "var_idx").select("var_idx", "first_brand", "first_price")


@query(", l as (select var_idx, p_size as s, brand as b from var where var_idx % 3 <> 0), r as (select var_idx, p_size * 2 as s, 'x' as extra from var where var_idx % 2 = 0) select coalesce(r.var_idx, l.var_idx) as var_idx, coalesce(r.s, l.s) as s, l.b, r.extra from l full join r using (var_idx)")
def q_overlay(spark, d):
    v = var(spark, d)
    left = v.filter("var_idx % 3 <> 0").select("var_idx", F.col("p_size").alias("s"), F.col("brand").alias("b"))
    right = v.filter("var_idx % 2 = 0").select("var_idx", (F.col("p_size") * 2).alias("s"), F.lit("x").alias("extra"))
    return J.overlay(left, right, "var_idx")


@query(", l as (select var_idx, p_size / 2.0::double as loading from var where highly_variable) select var_idx, loading from var left join l using (var_idx)")
def q_pad_loadings(spark, d):
    v = var(spark, d)
    return J.pad(v.select("var_idx"), v.filter("highly_variable").select("var_idx", (F.col("p_size") / 2).alias("loading")), "var_idx")


@query("select c_custkey, 'old' as origin from customer where c_custkey % 2 = 0 union all select c_custkey, 'new' from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0", base=False)
def q_anti_append(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return J.append(c.filter("c_custkey % 2 = 0").withColumn("origin", F.lit("old")), c.filter("c_custkey % 3 = 0").withColumn("origin", F.lit("new")), "c_custkey")


@query("select var_idx, row_number() over (order by var_idx) - 1 as new_idx from var where var_id in (select var_id from var where p_size = 50)")
def q_semi_scaled(spark, d):
    v = var(spark, d)
    return positions(J.semi(v, v.filter("p_size = 50"), "var_id").select("var_idx"), "var_idx", out="new_idx")


@query("select c_custkey as i, obs_id, c_name from customer join obs on c_custkey = obs_idx")
def q_positional_join(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), "c_name")
    return J.zip_positions(left, obs(spark, d).select("obs_idx", "obs_id"), "i", "obs_idx")


def _thresholds(share: int) -> str:
    """Parts that have a match: share of 12 of them."""
    return f"select v.var_idx, case when how <> 'none' then m.x end as x, how from var v left join (select var_idx, p_size as x from var where var_idx % 12 < {share}) m using (var_idx), (select case when count(*) = count(*) filter (var_idx % 12 < {share}) then 'matched' when count(*) filter (var_idx % 12 < {share}) > 0.5 * count(*) then 'filled' else 'none' end as how from var) h"


@query(" union all ".join(f"select {k}::int as share, * from ({_thresholds(k)})" for k in (12, 9, 4)))
def q_threshold_join(spark, d):
    v, out = var(spark, d).select("var_idx", "p_size"), None
    for k in (12, 9, 4):
        one = J.threshold(v.select("var_idx"), v.filter(F.col("var_idx") % 12 < k).select("var_idx", F.col("p_size").alias("x")), "var_idx", 0.5).select(F.lit(k).alias("share"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(", n as (select o_custkey % 50 as g, count(*) as k from orders group by 1), s as (select g, k, coalesce(sum(k) over (order by g rows between unbounded preceding and 1 preceding), 0) as start from n) select g::bigint as g, unnest(range(start::bigint, (start + k)::bigint)) as pos from s")
def q_rle_expand(spark, d):
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("g")).agg(F.count("*").alias("k"))
    return L.expand_runs(running_sum(n, "k", "g").withColumn("start", F.col("running") - F.col("k")), "start", "k").select("g", "pos")


# --- spatial -----------------------------------------------------------------------------------------------------

_MOL = "(select event_id, (event_id % 97)::bigint as x, (user_id % 89)::bigint as y, event_type as gene, 1 as n from events)"
_POLY = "(select s_suppkey as cell, v, (10 * s_suppkey + case when v in (1, 2) then 2 else 0 end)::double as x, (20 * s_suppkey + case when v in (2, 3) then 2 else 0 end)::double as y from supplier, range(0, 4) r(v))"


def _molecules(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("x"), (F.col("user_id") % 89).alias("y"), F.col("event_type").alias("gene"))


def _polygons(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("v"))
    off = lambda *at: F.when(F.col("v").isin(*at), 2).otherwise(0)
    return p.select("cell", "v", (F.col("cell") * 10 + off(1, 2)).cast("double").alias("x"), (F.col("cell") * 20 + off(2, 3)).cast("double").alias("y"))


@query(f"with m as {_MOL}, s as (select x, y, dense_rank() over (order by x, y) - 1 as spot from (select distinct x, y from m)) select spot, 'spot_' || x || '_' || y as spot_id, gene, sum(n)::bigint as value from m join s using (x, y) group by all", base=False)
def q_gef_spots(spark, d):
    return S.spot_counts(_molecules(spark, d).withColumn("n", F.lit(1)), "n")


@query(f"with m as {_MOL}, g as (select gene, count(*) as k from m group by 1) select (select sum(k) from g)::bigint as announced, (select count(*) from m)::bigint as stored, true as consistent", base=False)
def q_gef_checksum(spark, d):
    m = _molecules(spark, d)
    return S.checksum(m.groupBy("gene").agg(F.count("*").alias("k")), "k", m)


@query(f"select cell, avg(x) as cx, avg(y) as cy from {_POLY} group by 1", base=False)
def q_centroids(spark, d):
    return S.centroids(_polygons(spark, d))


@query(f"with p as {_POLY}, n as (select cell, count(*) as k from p group by 1) select cell, k::bigint as vertices, (sum(k) over (order by cell))::bigint as offset_end from n", base=False)
def q_polygon_offsets(spark, d):
    return S.polygon_offsets(_polygons(spark, d))


@query("with e as (select event_id, event_type, case when event_type = lag(event_type) over (order by event_id) then 0 else 1 end as new from events), i as (select event_type, sum(new) over (order by event_id) as island from e) select island::bigint as island, any_value(event_type) as value, count(*)::bigint as run from i group by 1", base=False)
def q_rle_islands(spark, d):
    e = positions(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return islands(e, "event_type", "idx").groupBy(long("island").alias("island")).agg(F.first("event_type").alias("value"), long(F.count("*")).alias("run"))


@query("select median(s_acctbal) as median_radius from supplier", base=False)
def q_median_radius(spark, d):
    return table(spark, d, "supplier").agg(F.median("s_acctbal").alias("median_radius"))


@query(f"with m as {_MOL} select count(*)::bigint as n, count(distinct x)::bigint as nx, count(distinct y)::bigint as ny, case when count(distinct x) < count(*) / 2 and count(distinct y) < count(*) / 2 then 'Visium' when count(*) > 50000 then 'HighDensitySpatial' else 'Generic' end as technology from m", base=False)
def q_tech_detect(spark, d):
    return S.technology(_molecules(spark, d))


@query("with px as (select event_id as pos, abs(value) as v from events), k as (select case when max(v) <= 1 then 1 when max(v) <= 255 then 255 when max(v) <= 65535 then 65535 else max(v) end as top from px) select pos, round(least(greatest(v / top, 0), 1), 9) as v from px, k", base=False)
def q_image_norm(spark, d):
    px = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.abs("value").alias("v"))
    return S.normalise_pixels(px).select("pos", F.round("v", 9).alias("v"))


@query("with px as (select event_id, event_id // 1800 as image, event_id % 1800 as pos from events) select event_id, (pos // 600)::bigint as c, ((pos % 600) // 30)::bigint as h, (pos % 30)::bigint as w, (((pos % 600) // 30 * 30 + pos % 30) * 3 + pos // 600)::bigint as hwc, image::bigint as image from px", base=False)
def q_hwc_permute(spark, d):
    images = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 1800).alias("image"), (F.col("event_id") % 1800).alias("pos"))
    return S.chw_to_hwc(images, 3, 20, 30).drop("pos")


@query("with px as (select event_id, event_id // 960 as image, event_id % 960 as pos from events) select image::bigint as image, event_id, ((pos % 120) // 4 // 5)::bigint as h, ((pos % 120) // 4 % 5)::bigint as w, (pos % 4)::bigint as c, (pos % 120)::bigint as hwc from px where pos // 480 = 0 and pos % 480 // 120 = 0", base=False)
def q_image_axes(spark, d):
    """Time and depth at 0, channels last: 2 x 4 x 6 x 5 x 4."""
    images = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 960).alias("image"), (F.col("event_id") % 960).alias("pos"))
    return S.to_hwc(images, [2, 4, 6, 5, 4], ["t", "z", "y", "x", "c"]).select("image", "event_id", "h", "w", "c", "hwc")


@query("with t as (select event_id as pos, event_id // 100 as h, event_id % 100 as w from events) select (h // 16)::bigint as tile_y, (w // 16)::bigint as tile_x, count(*)::bigint as pixels, (256 - count(*))::bigint as padding from t group by 1, 2", base=False)
def q_image_tiles(spark, d):
    px = table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("h"), (F.col("event_id") % 100).alias("w"))
    return S.tiles(px, 16)


_SCALES = ["spot", "fiducial", "hires", "lowres", "other"]


@query(f"""with {_picks(_SCALES)}, k as (select file, name, (file * 10 + pos + 1)::double as value from o where not (name = 'lowres' and file % 2 = 0)),
v as (select file, case name when 'spot' then 'spot_diameter_fullres' when 'fiducial' then 'fiducial_diameter_fullres' when 'hires' then 'tissue_hires_scalef' when 'lowres' then 'tissue_lowres_scalef' else name end as stored, case when name in ('spot', 'fiducial') then value / 2 else value end as value from k)
select * from v union all select file, 'tissue_lowres_scalef', value from v where stored = 'tissue_hires_scalef' and file % 2 = 0 or stored = 'tissue_hires_scalef' and file not in (select file from v where stored = 'tissue_lowres_scalef')""", base=False)
def q_scalefactors(spark, d):
    f = _picked(spark, d, _SCALES).filter("not (name = 'lowres' and file % 2 = 0)")
    return S.scale_factors(f.select("file", "name", (F.col("file") * 10 + F.col("pos") + 1).cast("double").alias("value")), ("file",))


# --- multimodal --------------------------------------------------------------------------------------------------

_MODS = "m as (select 'rna' as modality, 0 as ord, var_idx as idx, var_id || ' ' || brand as name from var union all select 'prot', 1, row_number() over (order by var_idx) - 1, var_id || ' ' || brand from var where highly_variable)"


def _modality_vars(spark, d):
    v = var(spark, d).withColumn("name", F.concat("var_id", F.lit(" "), "brand"))
    rna = v.select(F.lit("rna").alias("modality"), F.lit(0).alias("ord"), F.col("var_idx").alias("idx"), "name")
    some = positions(v.filter("highly_variable").select("var_idx", "name"), "var_idx", out="idx")
    return rna.unionByName(some.select(F.lit("prot").alias("modality"), F.lit(1).alias("ord"), "idx", "name"))


@query(f", {_MODS}, g as (select *, row_number() over (order by ord, idx) - 1 as global_idx from m), c as (select name from m group by 1 having count(distinct modality) > 1) select modality, idx, global_idx, case when name in (select name from c) then modality || ':' || name else name end as global_name from g")
def q_var_concat(spark, d):
    return MM.concat_names(_modality_vars(spark, d)).select("modality", "idx", "global_idx", "global_name")


@query(f", {_MODS}, g as (select *, row_number() over (order by ord, idx) - 1 as global_idx from m) select o.modality, g.global_idx, case when o.modality = g.modality then row_number() over (partition by o.modality, o.modality = g.modality order by g.global_idx) - 1 else -1 end as local_idx from g cross join (select distinct modality from m) o")
def q_varmap(spark, d):
    return MM.var_map(MM.concat_names(_modality_vars(spark, d)))


@query("select modality, obs_idx as global_idx, obs_idx as local_idx from obs cross join (values ('rna'), ('prot')) m(modality)")
def q_obsmap(spark, d):
    return MM.obs_map(obs(spark, d), ["rna", "prot"])


@query("with a as (select distinct p_brand as x from part where p_size < 20), b as (select distinct p_brand as x from part where p_size > 48) select 'both' as side, x from (select x from a intersect select x from b) union all select 'left', x from (select x from a except select x from b) union all select 'right', x from (select x from b except select x from a)", base=False)
def q_setops(spark, d):
    p = table(spark, d, "part")
    return MM.compare_sets(p.filter("p_size < 20").select(F.col("p_brand").alias("x")), p.filter("p_size > 48").select(F.col("p_brand").alias("x")))


@query("select 'rna' as modality, count(*)::bigint as cells, 0::bigint as missing, 0::bigint as moved, true as valid from obs union all select 'prot', count(*), (select count(*) from obs where obs_idx % 10 = 0), 0, false from obs where obs_idx % 10 <> 0")
def q_multimodal_valid(spark, d):
    o = obs(spark, d).select("obs_idx", "obs_id")
    return MM.validate(o, {"rna": o, "prot": o.filter("obs_idx % 10 <> 0")})


@query("select grp as library, count(*)::bigint as cells, min(obs_idx) as first_idx from obs group by 1")
def q_library_split(spark, d):
    return MM.libraries(obs(spark, d), "grp")


# --- integrity and provenance ------------------------------------------------------------------------------------

_PLACES = ["layers/counts", "raw/X", "X", "nowhere"]


@query("""with f as (select p_partkey as file, p_size % 2 = 1 as layer, p_size // 2 % 2 = 1 as raw, case when p_size // 4 % 2 = 1 then ['layers/counts', 'raw/X', 'X', 'nowhere'][p_partkey % 4 + 1] end as stamp from part)
select file, case when stamp = 'layers/counts' and layer or stamp = 'raw/X' and raw or stamp = 'X' then stamp when layer then 'layers/counts' when raw then 'raw/X' else 'X' end as counts_from from f""", base=False)
def q_counts_source(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    stamp = F.element_at(F.array(*[F.lit(x) for x in _PLACES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    place = lambda path, value=None: F.struct(F.lit(path).alias("path"), (F.lit(None).cast("string") if value is None else value).alias("value"))
    entries = F.array(place("X"), F.when(size % 2 == 1, place("layers/counts")), F.when(F.floor(size / 2) % 2 == 1, place("raw/X")), F.when(F.floor(size / 4) % 2 == 1, place("stamp", stamp)))
    manifest = p.select(F.col("p_partkey").alias("file"), F.explode(F.array_compact(entries)).alias("e")).select("file", "e.path", "e.value")
    return V.counts_source(manifest)


@query(", raw as (select obs_idx, var_idx, value from coo where var_idx % 5 <> 0) select 'counts' as layer, obs_idx, var_idx, value::double as value from raw union all select 'data', obs_idx, var_idx, round(ln(1 + value), 6) from coo")
def q_counts_convention(spark, d):
    c = coo(spark, d)
    x = c.select("obs_idx", "var_idx", F.round(F.log1p("value"), 6).alias("value"))
    return V.counts_convention(x, raw=c.filter("var_idx % 5 <> 0").select("obs_idx", "var_idx", F.col("value").cast("double").alias("value")), features=var(spark, d))


@query("select count(*)::bigint as n, count(*) filter (l_extendedprice <> floor(l_extendedprice))::bigint as fractional, bool_or(l_extendedprice <> floor(l_extendedprice)) as warn from lineitem", base=False)
def q_noninteger(spark, d):
    return V.non_integer(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value")))


@query(", r as (select obs_idx, case when obs_idx = 3 then 'other' else obs_id end as obs_id from obs where obs_idx <> 5) select (select count(*) from obs)::bigint as stored, (select count(*) from r)::bigint as loaded, 1::bigint as renamed, 1::bigint as missing, 0::bigint as duplicated, false as identical")
def q_verify_identity(spark, d):
    o = obs(spark, d).select("obs_idx", "obs_id")
    return V.identity(o, o.filter("obs_idx <> 5").withColumn("obs_id", F.when(F.col("obs_idx") == 3, "other").otherwise(F.col("obs_id"))), "obs_idx", "obs_id")


_SPELT = "(case when p_partkey % 3 = 0 then ' ' else '' end || p_name || case when p_partkey % 2 = 0 then ' / ' else ';' end || p_brand)"
_SPELT_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_SPELT}, '[/\\s,;:\\\\]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(f"with n as (select distinct {_SPELT} as name, {_SPELT_CLEAN} as clean from part) select clean, count(*)::bigint as n, min(name) as first_name, max(name) as last_name from n group by 1 having count(*) > 1", base=False)
def q_conflicts(spark, d):
    k = F.col("p_partkey")
    spelt = F.concat(F.when(k % 3 == 0, " ").otherwise(""), "p_name", F.when(k % 2 == 0, " / ").otherwise(";"), "p_brand")
    return N.conflicts(table(spark, d, "part").select(spelt.alias("name")), "name")


@query("select event_type as name, max(ts) as latest, max_by(event_id, (ts, event_id)) as event_id from events group by 1", base=False)
def q_latest_command(spark, d):
    return V.latest(table(spark, d, "events"), "event_type", "ts", "event_id")


@query("select vec_id, list_transform(embedding, lambda x: round(sqrt(x::double * x::double + 0.25), 6)) as stdev from embeddings", base=False)
def q_stdev(spark, d):
    variances = F.transform("embedding", lambda x: x.cast("double") * x.cast("double") + 0.25)
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.stdev_of(variances), lambda x: F.round(x, 6)).alias("stdev"))


_NESTED = """('{"p":' || props || ',"user":{"id":' || user_id || ',"tags":["' || event_type || '",' || (event_id % 7) || ',{"deep":{"er":true}}]},"none":null,"empty":{},"v":"x"}')"""


@query(f"""select e.event_id, replace(replace(replace(replace(t.fullkey, '$.', ''), '[', '/'), ']', ''), '.', '/') as path, case when t.type = 'OBJECT' then '{{}}' when t.type = 'VARCHAR' then json_extract_string(t.value, '$') else t.value::varchar end as value
from events e, json_tree(({_NESTED})::json) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')""", base=False)
def q_uns_flatten(spark, d):
    props = F.concat(F.lit('{"p":'), "props", F.lit(',"user":{"id":'), "user_id", F.lit(',"tags":["'), "event_type", F.lit('",'), (F.col("event_id") % 7).cast("string"), F.lit(',{"deep":{"er":true}}]},"none":null,"empty":{},"v":"x"}'))
    return V.flatten_json(table(spark, d, "events").select("event_id", props.alias("json")), "json", ["event_id"])


@query("select vec_id, k::bigint - 1 as dim, round(embedding[k]::double, 6) as value from embeddings, range(1, 65) r(k)", base=False)
def q_obsm_explode(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    return e.select("vec_id", long("dim").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


_FILES = ["a.H5AD", "b.cellbin.gef", "c.gef", "d.spatialdata.zarr", "e.zarr", "soma://x/y", "f.loom", "g.h5mu", "h.h5Seurat", "i.rds"]
_TYPES = ["h5ad", "cellbin.gef", "gef", "spatialdata.zarr", "zarr", "soma", "loom", "h5mu", "h5seurat", "rds"]


@query(f"with {_picks(_FILES)}, t(pos, ending) as (values {_values(_FILES)}), k(pos, kind) as (values {_values(_TYPES)}) select file, o.pos, file || '-' || name as name, kind from o join t on t.ending = o.name join k on k.pos = t.pos where not starts_with(name, 'soma') union all select file, pos, name, 'soma' from o where starts_with(name, 'soma')", base=False)
def q_file_type(spark, d):
    from ..sources.registry import file_type_column

    name = F.col("name")
    return _picked(spark, d, _FILES).withColumn("name", F.when(F.startswith(name, F.lit("soma")), name).otherwise(F.concat(F.col("file").cast("string"), F.lit("-"), name))).withColumn("kind", file_type_column(F.col("name")))


@query("select a.obs_idx as i, b.obs_idx as j, sum(least(a.value, b.value))::bigint as w from coo a join coo b on a.var_idx = b.var_idx and a.obs_idx <> b.obs_idx group by 1, 2")
def q_obsp_edges(spark, d):
    return S.overlap_graph(coo(spark, d))


@query(", e as (select a.obs_idx as i, b.obs_idx as j, sum(least(a.value, b.value)) as w from coo a join coo b on a.var_idx = b.var_idx and a.obs_idx <> b.obs_idx group by 1, 2), r as (select *, row_number() over (partition by i order by w desc, j) as k from e) select i, k::bigint as rank, j, w::bigint as w from r where k <= 5")
def q_neighbors(spark, d):
    return S.top_neighbours(S.overlap_graph(coo(spark, d)), 5)


# --- names, times, versions, addresses ------------------------------------------------------------------------------

_KEYS = ["pca_", "PC 1_", "__", "tSNE-2", "ümlaut_", "", "_x_y_"]


@query(f"with {_picks(_KEYS)}, b as (select *, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') as bare from o) select file, pos, name, case when regexp_matches(name, '^[A-Za-z0-9]+_$') then name when bare = '' then 'key' || file || '_' else bare || '_' end as key, case when name = '' then 'index' || (pos + 1) else name end as padded from b", base=False)
def q_update_key(spark, d):
    return _picked(spark, d, _KEYS).withColumns({"key": N.update_key(F.col("name"), F.concat(F.lit("key"), F.col("file").cast("string"))), "padded": N.pad_name(F.col("name"), F.col("pos"))})


_MISC = ["params", "__varp__", "__varp__.corr", ".__path__", "varp", "x.__y"]


@query(f"with {_picks(_MISC)} select file, pos, name from o where name in ('params', 'varp', 'x.__y')", base=False)
def q_misc_keys(spark, d):
    return _picked(spark, d, _MISC).filter(~N.is_private(F.col("name")))


@query("select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as plain, strftime(ts, '%Y%m%dT%H%M%S.%fZ') as loom, date_trunc('second', ts) as back from events", base=False)
def q_timestamps(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumns({"plain": X.format_time(F.col("ts")), "loom": X.format_time(F.col("ts"), "loom")})
    return e.select("event_id", "plain", "loom", X.parse_time(F.col("plain")).cast("timestamp_ntz").alias("back"))


_VERSIONS = ["3.1.2", "3.1.5.9900", "3.2.0", "4.0.0"]


@query(f"""with v as (select p_partkey, (p_size // 10)::varchar || '.' || (p_size % 10)::varchar || '.' || (p_partkey % 7)::varchar as version from part), t as (select unnest([{', '.join(f"'{x}'" for x in _VERSIONS)}]) as target),
n as (select p_partkey, version, target, list_transform(string_split(version, '.'), lambda x: x::bigint) as a, list_transform(string_split(target, '.'), lambda x: x::bigint) as b from v, t)
select p_partkey, version, max_by(target, b) filter (b <= a) as floor_version, min_by(target, b) filter (b > a) as ceil_version from n group by 1, 2""", base=False)
def q_closest_version(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("version"))
    return v.withColumns({"floor_version": X.closest_version(F.col("version"), _VERSIONS), "ceil_version": X.closest_version(F.col("version"), _VERSIONS, up=True)})


@query("""with u as (select page_id, case page_id % 4 when 0 then 'S3://bucket-' || page_id || '/a/b.zarr/' when 1 then 'gs://store' || page_id || '/x.zarr' when 2 then 's3://only' || page_id else url end as url from pages),
p as (select *, regexp_replace(url, '/+$', '') as bare from u), q as (select *, lower(regexp_extract(bare, '^([A-Za-z0-9]+)://', 1)) as scheme, regexp_replace(bare, '^[A-Za-z0-9]+://', '') as rest from p),
r as (select *, split_part(rest, '/', 1) as bucket, case when contains(rest, '/') then substr(rest, strpos(rest, '/') + 1) else '' end as prefix from q)
select page_id, case when scheme in ('s3', 'gs') then scheme else 'http' end as kind, case scheme when 's3' then 'https://' || bucket || '.s3.amazonaws.com' when 'gs' then 'https://storage.googleapis.com/' || bucket else bare end || case when scheme in ('s3', 'gs') and prefix <> '' then '/' || prefix else '' end as base,
  case when scheme in ('s3', 'gs') then bucket end as bucket, case when scheme in ('s3', 'gs') then prefix end as prefix, md5(url || chr(10)) as cache from r""", base=False)
def q_store_address(spark, d):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("S3://bucket-"), k, F.lit("/a/b.zarr/"))).when(k % 4 == 1, F.concat(F.lit("gs://store"), k, F.lit("/x.zarr"))).when(k % 4 == 2, F.concat(F.lit("s3://only"), k)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.store_address(url).alias("a"), X.cache_key(url).alias("cache")).select("page_id", "a.*", "cache")


@query("with g as (select event_type as grp, user_id as list_no, list(distinct value::varchar order by value::varchar) as items from events group by 1, 2), e as (select grp, list_no, unnest(items) as item, generate_subscripts(items, 1) as k from g), f as (select grp, item, min((list_no, k)) as first from e group by 1, 2) select grp, item, row_number() over (partition by grp order by first) - 1 as pos from f", base=False)
def q_item_union(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("list_no")).agg(F.sort_array(F.collect_set(F.col("value").cast("string"))).alias("items"))
    return MM.item_union(g, "grp", "items", "list_no")


@query(f"with {_picks(_OBSM, 5)} select file, name as image, row_number() over (partition by file order by name) - 1 as rank, name = min(name) over (partition by file) as is_primary from o", base=False)
def q_image_order(spark, d):
    return MM.primary_image(_picked(spark, d, _OBSM, 5).select("file", F.col("name").alias("image")), ("file",))


@query(f"with {_picks(_ASSAYS, 2)} select file, pos, name, (row_number() over (partition by file order by name <> 'ADT', pos) - 1)::bigint as shown from o", base=False)
def q_default_first(spark, d):
    return MM.default_first(_picked(spark, d, _ASSAYS, 2).withColumn("d", F.col("name") == "ADT"), ("file",), "d").drop("d")


@query("select event_id, value, row_number() over (order by (event_id * 7919) % 1000003, event_id) - 1 as stored from events", base=False)
def q_stored_order(spark, d):
    e = table(spark, d, "events").select("event_id", "value").withColumn("at", (F.col("event_id") * 7919) % 1000003)
    return J.by_stored_index(e, "at", "event_id", "stored")


@query("select date_trunc('day', ts) as begin, (event_id % 97)::bigint as x, (user_id % 89)::bigint as y, event_type as gene, count(*)::bigint as value from events group by all", base=False)
def q_window_spots(spark, d):
    rows = table(spark, d, "events").select("ts", (F.col("event_id") % 97).alias("x"), (F.col("user_id") % 89).alias("y"), F.col("event_type").alias("gene"))
    return windowed_spots(rows).withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from g)
select user_id, min(ts) as begin, max(ts) + interval 30 minutes as end, count(*)::bigint as rows from s group by user_id, n""", base=False)
def q_sessions(spark, d):
    found = sessions(table(spark, d, "events").select("user_id", "ts"), "user_id")
    return found.withColumns({"begin": F.col("begin").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
