"""Every operator as a query over the given tables, with its SQL twin where SQL can say it.

A query takes (spark, folder) and reads whole tables. Fractions are rounded on both sides.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facets.constants import (BLANKS, CATEGORY_RULES, DEFAULT_CATEGORY, MISSING_MARKS,
                              NUMERIC_FEATURES, PROMPT_HEAD, PROMPT_TAIL, STOP_WORDS)
from facets.functions.numeric import clip, with_holiday_flag
from facets.functions.text import truncate, with_category
from facets.operators import (cluster, compare, density, features, graph, hierarchy, labels,
                              layout, neighbors, profile, rows, temporal, terms, topics)
from facets.operators.centers import TOLERANCE, fit_many
from facets.plans.prepare import clean_reviews
from facets.session import cut, ship_package, use_checkpoint_dir
from facets.sources import reviews as sources

CLUSTERS = (0, 1, 2, 3, 4)
STARS = (1, 2, 3, 4, 5)
CATEGORIES = tuple(name for name, _ in CATEGORY_RULES) + (DEFAULT_CATEGORY,)

QUERIES: dict = {}
ORACLES: dict = {}


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`")
                      for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its fractional columns are rounded to ``digits``."""
    def register(build):
        @functools.wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return _rounded(build(spark, folder), digits)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def raw(spark, folder):
    return sources.reviews_from_tables(spark, folder)


def clean(spark, folder):
    return clean_reviews(raw(spark, folder))


def staged(spark, folder, *columns):
    """Columns of the cleaned reviews, written once for a query that reads them several times."""
    return cut(clean(spark, folder).select(*columns))


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"))


def plane(spark, folder):
    """Two fixed linear combinations of all dimensions: the scaled sums of the even and the odd."""
    def total(odd: int):
        return F.aggregate(F.filter("vec", lambda v, i: i % 2 == odd), F.lit(0.0),
                           lambda s, v: s + v) / F.sqrt(F.lit(32.0))
    return vectors(spark, folder).select("vec_id", total(0).alias("x"), total(1).alias("y"))


# ---------------------------------------------------------------- SQL building blocks

def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


RAW = """
raw as (
  select d.doc_id as Id, concat('P', d.doc_id % p.n) as ProductId,
         concat('U', o.o_custkey) as UserId,
         cast(coalesce(l.num, 0) as int) as HelpfulnessNumerator,
         cast(coalesce(l.den, 0) as int) as HelpfulnessDenominator,
         cast(substr(o.o_orderpriority, 1, 1) as int) as Score,
         cast(epoch(o.o_orderdate) as bigint) as Time,
         substr(d.text, 1, 60) as Summary, d.text as Text,
         cast(o.o_custkey % 5 as int) as cluster
  from documents d join orders o on o.o_orderkey = d.doc_id
  cross join (select count(*) as n from part) p
  left join (select l_orderkey, count(*) as den,
                    count(case when l_returnflag = 'N' then 1 end) as num
             from lineitem group by l_orderkey) l on l.l_orderkey = d.doc_id)"""

_WORDS_SQL = f"len(list_filter(regexp_split_to_array(Text, '[{BLANKS}]+'), lambda x: x <> ''))"
_CLEAN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace("
    "lower(concat(coalesce(Summary, ''), ' ', coalesce(Text, ''))), '<[^>]+>', ' ', 'g'), "
    f"'http[^{BLANKS}]+', ' ', 'g'), '[^a-z]+', ' ', 'g'))")

REVIEWS = f"""{RAW},
kept as (select * exclude (rn) from (
    select *, row_number() over (partition by UserId, Time, Text order by Id) as rn from raw)
  where rn = 1 and Text is not null and Summary is not null),
base as (
  select *, make_timestamp(Time * 1000000) as Date, cast(length(Text) as int) as text_length,
         cast({_WORDS_SQL} as int) as word_count, cast(length(Summary) as int) as summary_length,
         HelpfulnessNumerator::double / (HelpfulnessDenominator + 1) as helpfulness_ratio,
         {_CLEAN_SQL} as clean_text
  from kept),
reviews as (
  select *, cast(year(Date) as int) as "Year", cast(month(Date) as int) as "Month",
         cast(quarter(Date) as int) as "Quarter",
         ln(1 + word_count) as log_word_count, ln(1 + summary_length) as log_summary_length,
         ln(1 + HelpfulnessDenominator) as log_total_votes, (Score - 1) / 4.0::double as rating_norm
  from base)"""

_CATEGORY_SQL = "case " + " ".join(
    "when " + " or ".join(f"contains(body, '{w}')" for w in words) + f" then '{name}'"
    for name, words in CATEGORY_RULES) + f" else '{DEFAULT_CATEGORY}' end"
CATEGORIZED = f"""{REVIEWS},
categorized as (select *, {_CATEGORY_SQL} as category from (
  select *, lower(concat(coalesce(Summary, ''), ' ', coalesce(Text, ''))) as body from reviews))"""

# Terms of every review: (Id, cluster, term, tf).
COUNTED = f"""{REVIEWS},
worded as (select Id, cluster, list_filter(string_split(clean_text, ' '),
    lambda w: length(w) >= 2 and w not in ({_in(STOP_WORDS)})) as w from reviews),
listed as (select Id, cluster, list_concat(w, list_transform(range(1, len(w)),
    lambda i: concat(w[i], ' ', w[i + 1]))) as t from worded),
counted as (select Id, cluster, term, count(*) as tf
  from (select Id, cluster, unnest(t) as term from listed) group by all)"""


def _sql(body: str, base: str = REVIEWS) -> str:
    return f"with {base} {body}"


def _drawn(key: str) -> str:
    return f"md5(concat('42:', {key})), {key}"


_SHARE = "100.0::double * count(case when {0} then 1 end) / count(*)"
_FIVE, _ONE = _SHARE.format("Score = 5"), _SHARE.format("Score = 1")
_PROFILE = f"""count(*) as n_reviews, round(avg(Score), 6) as avg_rating,
  round({_FIVE}, 6) as pct_5star, round({_ONE}, 6) as pct_1star,
  round(avg(word_count), 6) as avg_words, round(avg(helpfulness_ratio), 6) as avg_helpfulness"""


def _pivot(row: str, col: str, values, alias, total: str, cell: str = "count") -> str:
    cells = ", ".join(
        f"""round(100.0::double * count(case when {col} = {v!r} then 1 end)
            / nullif({total}, 0), 6) as "{alias(v)}" """ for v in values)
    return f"select {row}, {cells}"


# ---------------------------------------------------------------- sources and rows

@query("reviews_from_tables", _sql("select * from raw", RAW))
def _(spark, folder):
    return raw(spark, folder)


@query("csv_round_trip", _sql(
    "select Id, ProductId, UserId, HelpfulnessNumerator, HelpfulnessDenominator, Score, Time, "
    f"case when Summary not in ({_in(MISSING_MARKS)}) then Summary end as Summary, "
    f"case when Text not in ({_in(MISSING_MARKS)}) then Text end as Text, "
    "cast(cluster as varchar) as cluster from raw", RAW))
def _(spark, folder):
    path = f"{use_checkpoint_dir(spark)}/facets-csv-{np.random.default_rng().integers(1 << 62)}"
    sources.write_assigned(raw(spark, folder), path, "csv")
    return sources.read_reviews(spark, path)


@query("load_report", _sql("""
  select (select count(*) from raw) as rows_read, count(*) as rows_kept, min(Date) as first_date,
         max(Date) as last_date, count(distinct ProductId) as products,
         count(distinct UserId) as users, round(avg(length(clean_text)), 6) as avg_clean_length,
         substr(arg_min(clean_text, Id), 1, 150) as example from reviews"""))
def _(spark, folder):
    return sources.load_report(raw(spark, folder), clean(spark, folder))


@query("dedup_keep_first", _sql("""
  select Id, UserId, Score, cast(length(Text) as int) as n from (
    select *, row_number() over (partition by Text order by Id) as rn from raw) where rn = 1""",
    RAW))
def _(spark, folder):
    return rows.dedup_keep_first(raw(spark, folder), ["Text"]).select(
        "Id", "UserId", "Score", F.length("Text").alias("n"))


@query("drop_missing", """select d.doc_id, l.quality, l.toxic from documents d
  left join labels l on l.doc_id = d.doc_id where l.quality is not null""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    wide = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.drop_missing(wide, ["quality"])


@query("sample_exact", f"select o_orderkey, o_custkey from orders order by {_drawn('o_orderkey')} "
                       "limit 5000")
def _(spark, folder):
    return rows.sample_exact(table(spark, folder, "orders"), 5000, key="o_orderkey").select(
        "o_orderkey", "o_custkey")


@query("sample_per_group", f"""select o_orderkey, o_orderstatus from (
  select *, row_number() over (partition by o_orderstatus order by {_drawn('o_orderkey')}) as rn
  from orders) where rn <= 3000""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return rows.sample_per_group(orders, "o_orderstatus", 3000, key="o_orderkey")


@query("voted_reviews", _sql("""select Id, Score, cluster, HelpfulnessDenominator from reviews
  where HelpfulnessDenominator > 2 and cluster = 1"""))
def _(spark, folder):
    return clean(spark, folder).where(
        (F.col("HelpfulnessDenominator") > 2) & (F.col("cluster") == 1)).select(
            "Id", "Score", "cluster", "HelpfulnessDenominator")


@query("keep_frequent", _sql("""select Id, "Year" from reviews where "Year" in (
  select "Year" from reviews group by "Year" having count(*) >= 150)"""))
def _(spark, folder):
    return rows.keep_frequent(staged(spark, folder, "Id", "Year"), "Year", 150)


@query("row_index", """select cast(row_number() over (
  order by o_totalprice desc, o_orderkey) - 1 as bigint) as idx, o_orderkey from orders""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rows.with_index(orders, F.desc("o_totalprice"), F.col("o_orderkey")).select(
        "idx", "o_orderkey")


# ---------------------------------------------------------------- columns

@query("calendar", _sql('select Id, Date, "Year", "Month", "Quarter" from reviews'))
def _(spark, folder):
    return clean(spark, folder).select("Id", "Date", "Year", "Month", "Quarter")


@query("lengths", _sql("select Id, text_length, word_count, summary_length from reviews"))
def _(spark, folder):
    return clean(spark, folder).select(
        "Id", "text_length", "word_count", "summary_length")


@query("helpfulness", _sql("select Id, round(helpfulness_ratio, 6) as helpfulness_ratio "
                           "from reviews"))
def _(spark, folder):
    return clean(spark, folder).select("Id", "helpfulness_ratio")


@query("clean_text", _sql("select Id, clean_text from reviews"))
def _(spark, folder):
    return clean(spark, folder).select("Id", "clean_text")


@query("numeric_features", _sql(
    "select Id, " + ", ".join(f"round({c}, 6) as {c}" for c in NUMERIC_FEATURES) +
    " from reviews"))
def _(spark, folder):
    return clean(spark, folder).select("Id", *NUMERIC_FEATURES)


@query("clipped_words", _sql("select Id, least(greatest(word_count, 0), 500) as words "
                             "from reviews"))
def _(spark, folder):
    return clean(spark, folder).select("Id", clip("word_count", 0, 500).alias("words"))


@query("truncated_text", _sql("select Id, substr(Text, 1, 220) as start from reviews"))
def _(spark, folder):
    return clean(spark, folder).select("Id", truncate("Text", 220).alias("start"))


@query("category", _sql("select Id, category from categorized", CATEGORIZED))
def _(spark, folder):
    return with_category(clean(spark, folder)).select("Id", "category")


@query("holiday_flag", _sql('select Id, "Month" in (11, 12, 1) as is_holiday from reviews'))
def _(spark, folder):
    return with_holiday_flag(clean(spark, folder)).select("Id", "is_holiday")


# ---------------------------------------------------------------- reports

@query("summary_stats", _sql(f"""select count(*) as n_reviews, round(avg(Score), 6) as avg_score,
  median(word_count) as median_words, count(case when HelpfulnessDenominator > 0 then 1 end)
  as n_voted, round({_SHARE.format("HelpfulnessDenominator > 0")}, 6) as pct_voted
  from reviews"""))
def _(spark, folder):
    return profile.summary_stats(clean(spark, folder))


@query("rating_distribution", _sql("""select cast(s.range as int) as Score, count(r.Id) as n,
  round(100.0::double * count(r.Id) / (select count(*) from reviews), 6) as pct
  from range(1, 6) s left join reviews r on r.Score = s.range group by 1"""))
def _(spark, folder):
    return profile.rating_distribution(clean(spark, folder))


def _histogram_sql(value: str, where: str, bins: int) -> str:
    return _sql(f"""
      , v as (select cast({value} as double) as v from reviews where {where}),
      edge as (select min(v) as lo, (max(v) - min(v)) / {bins} as w from v),
      hit as (select least(floor((v - lo) / w), {bins - 1}) as bin, count(*) as n
              from v, edge group by 1)
      select b.range as bin, round(lo + b.range * w, 6) as lower,
             round(lo + (b.range + 1) * w, 6) as upper, coalesce(n, 0) as n
      from range({bins}) b cross join edge left join hit on hit.bin = b.range""")


@query("histogram_words", _histogram_sql("least(greatest(word_count, 0), 600)", "true", 70))
def _(spark, folder):
    return profile.histogram(staged(spark, folder, "word_count"), "word_count", 70, 0, 600)


@query("histogram_helpfulness", _histogram_sql("helpfulness_ratio", "HelpfulnessDenominator > 0",
                                               50))
def _(spark, folder):
    voted = cut(clean(spark, folder).where(F.col("HelpfulnessDenominator") > 0)
                .select("helpfulness_ratio"))
    return profile.histogram(voted, "helpfulness_ratio", 50)


@query("by_year", _sql("""select "Year", count(*) as n_reviews, round(avg(Score), 6) as avg_score
  from reviews group by 1"""))
def _(spark, folder):
    return profile.by_year(clean(spark, folder))


@query("star_share", _sql(f"""select "Year", round({_FIVE}, 6) as pct_5star,
  round({_ONE}, 6) as pct_1star from reviews group by 1"""))
def _(spark, folder):
    return profile.star_share_by(clean(spark, folder), "Year")


@query("box_stats", _sql("""
  , v as (select Score, least(greatest(word_count, 0), 500) as v from reviews),
  q as (select Score, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
        quantile_cont(v, 0.75) as q3 from v group by Score)
  select q.Score, any_value(n) as n, any_value(q1) as q1, any_value(median) as median,
    any_value(q3) as q3,
    least(min(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), any_value(q1))
      as whisker_low,
    greatest(max(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
      any_value(q3)) as whisker_high,
    count(*) filter (v not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers,
    round(any_value(median - 1.57::double * (q3 - q1) / sqrt(n)), 6) as notch_low,
    round(any_value(median + 1.57::double * (q3 - q1) / sqrt(n)), 6) as notch_high
  from q join v using (Score) group by q.Score"""))
def _(spark, folder):
    return profile.box_stats(clean(spark, folder))


@query("correlation", _sql(" union all ".join(
    f"select '{a}' as a, '{b}' as b, round(" + ("1.0::double" if a == b else f"corr({a}, {b})") +
    ", 6) as r from reviews" for a in NUMERIC_FEATURES for b in NUMERIC_FEATURES)
    .replace("round(1.0::double, 6) as r from reviews", "1.0::double as r")))
def _(spark, folder):
    return profile.correlation(clean(spark, folder), NUMERIC_FEATURES)


def _freq_sql(text: str, part: str, sample: int, top: int) -> str:
    return _sql(f"""
      , picked as (select * from (select *, row_number() over (partition by {part} order by
          {_drawn('Id')}) as rn from (select *, 0 as everything from reviews)) where rn <= {sample}),
      w as (select {part} as part, regexp_replace(unnest(regexp_extract_all(lower({text}),
          '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*')), '''s$', '') as word from picked),
      c as (select part, word, count(*) as n from w where word <> ''
          and not regexp_full_match(word, '\\p{{N}}+') and word not in ({_in(STOP_WORDS)})
          group by all),
      m as (select c.part, c.word, c.n + coalesce(p.n, 0) as n from c
          left join c p on p.part = c.part and p.word = concat(c.word, 's')
              and regexp_matches(p.word, '[^s]s$')
          where not (regexp_matches(c.word, '[^s]s$') and exists (
              select 1 from c s where s.part = c.part and concat(s.word, 's') = c.word))),
      r as (select *, row_number() over (partition by part order by n desc, word) as rank from m)
      select {'' if part == 'everything' else f'part as {part},'} cast(rank as int) as rank, word, n
      from r where rank <= {top}""")


@query("word_freq", _freq_sql("Text", "everything", 5000, 120))
def _(spark, folder):
    return terms.word_freq(staged(spark, folder, "Id", "Text"), "Text", 120, sample=5000)


@query("word_freq_by_cluster", _freq_sql("clean_text", "cluster", 3000, 80))
def _(spark, folder):
    docs = staged(spark, folder, "Id", "cluster", "clean_text")
    return terms.word_freq(docs, "clean_text", 80, "cluster", 3000)


@query("cluster_sizes", _sql("""select cluster, count(*) as n,
  round(100.0::double * count(*) / (select count(*) from reviews), 6) as pct
  from reviews group by 1"""))
def _(spark, folder):
    return profile.group_sizes(clean(spark, folder), "cluster")


@query("category_sizes", _sql("""select category, count(*) as n,
  round(100.0::double * count(*) / (select count(*) from reviews), 6) as pct
  from categorized group by 1""", CATEGORIZED))
def _(spark, folder):
    return profile.group_sizes(with_category(clean(spark, folder)), "category")


@query("cluster_profile", _sql(f"""select cluster, {_PROFILE},
  round(avg(HelpfulnessDenominator), 6) as avg_votes from reviews group by 1"""))
def _(spark, folder):
    return profile.profile(clean(spark, folder))


@query("community_profile", _sql(f"""select cluster, {_PROFILE},
  round(100.0::double * count(*) / (select count(*) from reviews), 6) as pct_reviews
  from reviews group by 1"""))
def _(spark, folder):
    return profile.profile(clean(spark, folder), "cluster", share=True)


@query("profile_scaled", _sql(f"""
  , p as (select cluster, avg(Score) as avg_rating, {_FIVE} as pct_5star, {_ONE} as pct_1star,
    avg(word_count) as avg_words, avg(helpfulness_ratio) as avg_helpfulness,
    avg(HelpfulnessDenominator) as avg_votes from reviews group by 1)
  select cluster, """ + ", ".join(
    f"round(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 6) as {c}"
    for c in profile.SCALED) + " from p"))
def _(spark, folder):
    scaled = profile.minmax_scale(cut(profile.profile(clean(spark, folder))), profile.SCALED)
    return scaled.drop("n_reviews")


@query("rating_mix", _sql(_pivot("cluster", "Score", STARS, lambda s: f"pct_{s}", "count(*)") +
                          " from reviews group by 1"))
def _(spark, folder):
    return profile.pivot_share(clean(spark, folder), "cluster", "Score", STARS, "pct_")


@query("category_crosstab", _sql(
    _pivot("cluster", "category", CATEGORIES, str, "count(*)") +
    " from categorized group by 1", CATEGORIZED))
def _(spark, folder):
    return profile.pivot_share(with_category(clean(spark, folder)), "cluster", "category",
                               CATEGORIES)


_LIVELY = """ from reviews where "Year" in (
  select "Year" from reviews group by 1 having count(*) >= 30) group by 1"""


@query("drift_share", _sql(_pivot('"Year"', "cluster", CLUSTERS, lambda c: f"c{c}", "count(*)") +
                           _LIVELY))
def _(spark, folder):
    return temporal.drift_share(staged(spark, folder, "Year", "cluster"), values=list(CLUSTERS))


@query("drift_rating", _sql('select "Year", ' + ", ".join(
    f"round(avg(case when cluster = {c} then Score end), 6) as c{c}" for c in CLUSTERS) + _LIVELY))
def _(spark, folder):
    scores = staged(spark, folder, "Year", "cluster", "Score")
    return temporal.drift_rating(scores, values=list(CLUSTERS))


@query("drift_stack", _sql("""
  , y as (select "Year", count(*) as total from reviews group by 1 having count(*) >= 30),
  s as (select y."Year", c.range as cluster, 100.0::double * count(r.Id) / any_value(total) as pct
    from y cross join range(5) c
    left join reviews r on r."Year" = y."Year" and r.cluster = c.range group by 1, 2)
  select "Year", cast(cluster as int) as cluster, round(pct, 6) as pct,
    round(coalesce(sum(pct) over (partition by "Year" order by cluster
      rows between unbounded preceding and 1 preceding), 0), 6) as base,
    round(sum(pct) over w, 6) as top from s
  window w as (partition by "Year" order by cluster rows unbounded preceding)"""))
def _(spark, folder):
    return temporal.drift_stack(staged(spark, folder, "Year", "cluster"), values=list(CLUSTERS))


@query("complaint_cluster", _sql("""select cluster, round(avg(Score), 6) as avg_score,
  count(*) as n_reviews from reviews group by 1 order by avg(Score), cluster limit 1"""))
def _(spark, folder):
    return temporal.complaint_cluster(clean(spark, folder))


@query("monthly_volume", _sql("""
  , worst as (select cluster from reviews group by 1 order by avg(Score), cluster limit 1)
  select cast(m.range as int) as "Month", count(r.Id) as n, m.range in (11, 12, 1) as is_holiday
  from range(1, 13) m left join (select * from reviews where cluster in (from worst)) r
    on r."Month" = m.range group by m.range"""))
def _(spark, folder):
    return temporal.monthly_volume(staged(spark, folder, "cluster", "Score", "Month"))


@query("group_cards", _sql("""select cluster, count(*) as n_reviews,
  round(avg(Score), 6) as avg_rating, round(avg(word_count), 6) as avg_words
  from reviews group by 1"""))
def _(spark, folder):
    return profile.group_cards(clean(spark, folder))


@query("noise_report", """select count(distinct case when label > 0 then label end) as n_clusters,
  count(case when label = 0 then 1 end) as n_noise,
  round(100.0::double * count(case when label = 0 then 1 end) / count(*), 6) as pct_noise
  from embeddings""")
def _(spark, folder):
    return profile.noise_report(vectors(spark, folder).select(
        (F.col("label") - 1).alias("dbscan_cluster")))


@query("explained_variance", _sql("""
  , t as (select Score as pc, count(*)::double / (select count(*) from reviews) as ratio
    from reviews group by 1),
  c as (select pc, ratio * 100 as pct, sum(ratio) over (order by pc) * 100 as cum from t)
  select pc, round(pct, 6) as pct, round(cum, 6) as cum_pct,
    cum >= 80 and cum - pct < 80 as reaches_80, cum >= 90 and cum - pct < 90 as reaches_90
  from c"""))
def _(spark, folder):
    # Shares of the star values stand for component ratios, which SQL could not compute.
    stars = staged(spark, folder, "Score")
    total = stars.agg(F.count("*")).scalar()
    return profile.explained_variance(stars.groupBy(F.col("Score").alias("pc")).agg(
        F.count("*").alias("_n")).select("pc", (F.col("_n") / total).alias("ratio")))


@query("helpfulness_scatter", _sql(f"""select Id, least(greatest(word_count, 0), 700) as words,
  round(helpfulness_ratio, 6) as helpfulness_ratio, Score from reviews
  where HelpfulnessDenominator > 2 order by {_drawn('Id')} limit 3000"""))
def _(spark, folder):
    return profile.helpfulness_scatter(staged(
        spark, folder, "Id", "word_count", "helpfulness_ratio", "HelpfulnessDenominator", "Score"))


# ---------------------------------------------------------------- terms and features

@query("tfidf", _sql("""
  , n as (select count(*) as n from reviews),
  v as (select term, ln((1.0::double + n) / (1 + count(*))) + 1 as idf, sum(tf) as cf
    from counted, n group by term, n having count(*) >= 5 and count(*) <= 0.85::double * n
    order by cf desc, term limit 8000),
  w as (select Id, term, (1 + ln(tf)) * idf as w from counted join v using (term))
  select Id, term, round(w / sqrt(sum(w * w) over (partition by Id)), 6) as weight from w""",
    COUNTED))
def _(spark, folder):
    return terms.tfidf(staged(spark, folder, "Id", "clean_text"))


@query("vocabulary", _sql("""
  , v as (select term, cast(sum(tf) as bigint) as cf, count(*) as df from counted group by term
    having count(*) >= 5 and count(*) <= 0.85::double * (select count(*) from reviews)
    order by cf desc, term limit 8000)
  select term, cf, df, cast(row_number() over (order by term) - 1 as int) as idx,
    round(ln((1.0::double + (select count(*) from reviews)) / (1 + df)) + 1, 6) as idf from v""",
    COUNTED))
def _(spark, folder):
    docs = staged(spark, folder, "Id", "cluster", "clean_text")
    return terms.vocabulary(terms.term_counts(docs), docs.count())


def _terms_sql(max_features: int, min_df: int, n: int) -> str:
    return f"""
      , t as (select cluster, term, sum(tf) as cf, count(*) as df from counted group by all
        having count(*) >= {min_df}),
      f as (select *, row_number() over (partition by cluster order by cf desc, term) as r from t),
      b as (select *, cast(row_number() over (partition by cluster order by df desc, term) as int)
        as rank from f where r <= {max_features}),
      best as (select cluster, rank, term, df from b where rank <= {n})"""


@query("top_terms", _sql(_terms_sql(3000, 1, 15) + " select * from best", COUNTED))
def _(spark, folder):
    return terms.top_terms(staged(spark, folder, "cluster", "clean_text"))


_LABEL_TERMS = _terms_sql(2000, 2, 12) + """,
  lists as (select cluster, list(term order by rank) as terms from best group by 1),
  label_terms as (select s.cluster, case when s.n < 5 then ['insufficient data']
      else coalesce(l.terms, ['error']) end as terms
    from (select cluster, count(*) as n from reviews group by 1) s left join lists l
      on l.cluster = s.cluster)"""


@query("label_terms", _sql(_LABEL_TERMS + """ select cluster, array_to_string(terms, ', ') as terms
  from label_terms""", COUNTED))
def _(spark, folder):
    found = terms.label_terms(staged(spark, folder, "Id", "cluster", "clean_text"))
    return found.withColumn("terms", F.array_join("terms", ", "))


@query("standardize", _sql("select Id, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}_std"
    for c in NUMERIC_FEATURES) + " from reviews"))
def _(spark, folder):
    scaled = features.standardize(
        staged(spark, folder, "Id", *NUMERIC_FEATURES), NUMERIC_FEATURES)
    return scaled.select("Id", *[f"{c}_std" for c in NUMERIC_FEATURES])


@query("fuse", """select vec_id, pos, round(value, 6) as value from (
  select vec_id, cast(i.range as int) as pos, case when i.range < 64
    then embedding[i.range + 1]::double else 0.6::double * label end as value
  from embeddings cross join range(65) i)""")
def _(spark, folder):
    fused = features.fuse(vectors(spark, folder), [("vec", 1.0), (["label"], 0.6)])
    return fused.select("vec_id", F.posexplode("fused").alias("pos", "value"))


@query("lsa", digits=3)
def _(spark, folder):
    docs = staged(spark, folder, "Id", "clean_text")
    weights, vocab = terms.tfidf_vectors(docs)
    out, _, _ = features.lsa(docs.select("Id"), cut(weights), vocab.count())
    return out.select("Id", F.posexplode("text_vec").alias("dim", "value"))


@query("pca", digits=4)
def _(spark, folder):
    out, _, _ = features.pca(vectors(spark, folder), "vec")
    return out.select("vec_id", F.posexplode("pca").alias("pc", "value"))


@query("pca_variance", """with x as (select vec_id, i.range as d, embedding[i.range + 1]::double as v
    from embeddings cross join range(64) i)
  select 1 as pc_total, round(sum(var), 6) as total from (
    select d, var_samp(v) as var from x group by d)""")
def _(spark, folder):
    # With all components kept, their variances add up to the total variance of the vectors.
    out, ratios, _ = features.pca(vectors(spark, folder), "vec", 64)
    parts = out.select(F.posexplode("pca").alias("pc", "v")).groupBy("pc").agg(
        F.var_samp("v").alias("var"))
    return parts.agg(F.lit(1).alias("pc_total"), F.sum("var").alias("total"))


@query("map2d", digits=4)
def _(spark, folder):
    return features.map2d(vectors(spark, folder), "vec").select("vec_id", "map_x", "map_y")


@query("map_neighbors", digits=3)
def _(spark, folder):
    return layout.neighbor_map(vectors(spark, folder), "vec_id", "vec")


@query("map_kept", "select count(*) as n_points, true as better from embeddings")
def _(spark, folder):
    # At sight of ten neighbours the map keeps at least twice as many as two principal components.
    points = cut(vectors(spark, folder))
    spots = cut(points.join(layout.neighbor_map(points, "vec_id", "vec").withColumnRenamed(
        "id", "vec_id"), "vec_id"))
    kept = layout.neighborhood_kept(spots, "vec_id", "vec")
    plain = layout.neighborhood_kept(features.map2d(points, "vec"), "vec_id", "vec")
    return spots.agg(F.count("map_x").alias("n_points"),
                     F.lit(kept.first()[0] >= 2 * plain.first()[0]).alias("better"))


@query("lsa_variance", digits=3)
def _(spark, folder):
    docs = staged(spark, folder, "Id", "clean_text")
    weights, vocab = terms.tfidf_vectors(docs)
    weights = cut(weights)
    loadings, energy = features.fit_lsa(weights, vocab.count())
    return profile.explained_variance(
        features.lsa_ratios(weights, docs.count(), loadings, energy))


# ---------------------------------------------------------------- neighbours and clusters

PAIRS = """
e as (select vec_id as id, label, embedding::double[] as v from embeddings),
p as (select a.id, b.id as nbr, list_distance(a.v, b.v) as dist from e a join e b on a.id <> b.id)"""
PLANE = """
v as (select vec_id as id, embedding::double[] as v from embeddings),
e as (select id, list_sum(list_filter(v, lambda x, i: i % 2 = 1)) / sqrt(32.0::double) as x,
  list_sum(list_filter(v, lambda x, i: i % 2 = 0)) / sqrt(32.0::double) as y from v),
p as (select a.id, b.id as nbr, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist
  from e a cross join e b)"""


@query("knn", f"""with {PAIRS} select id, rank, nbr, round(dist, 6) as dist from (
  select *, cast(row_number() over (partition by id order by dist, nbr) as int) as rank from p)
  where rank <= 10""")
def _(spark, folder):
    return neighbors.knn(vectors(spark, folder), "vec_id", "vec", 10)


@query("knn_cells", f"""with {PAIRS} select id, rank, nbr, round(dist, 6) as dist from (
  select *, cast(row_number() over (partition by id order by dist, nbr) as int) as rank from p)
  where rank <= 10""")
def _(spark, folder):
    # Looking through all lists, trained cells give the exact neighbours.
    return neighbors.knn(vectors(spark, folder), "vec_id", "vec", 10, method="cells", n_cells=12,
                         probes=12)


@query("knn_cells_recall", "select count(*) as n_points, true as reached from embeddings")
def _(spark, folder):
    points = cut(vectors(spark, folder))
    near = neighbors.knn(points, "vec_id", "vec", 10).withColumn("exact", F.lit(1))
    cells = neighbors.knn(points, "vec_id", "vec", 10, method="cells", n_cells=20, probes=16)
    both = near.join(cells.select("id", "nbr", F.lit(1).alias("found")), ["id", "nbr"], "left")
    return both.agg(F.count_distinct("id").alias("n_points"),
                    (F.sum("found") >= 0.95 * F.sum("exact")).alias("reached"))


@query("nearest_center", """with x as (select vec_id, label, i.range as d,
    embedding[i.range + 1]::double as v from embeddings cross join range(64) i),
  c as (select label, d, avg(v) as m from x group by 1, 2),
  g as (select vec_id, c.label, sqrt(sum((v - m) * (v - m))) as dist from x join c using (d)
    group by 1, 2)
  select vec_id, cast(arg_min(label, dist) as int) as cell, round(min(dist), 6) as cell_dist
  from g group by 1""")
def _(spark, folder):
    points = vectors(spark, folder)
    means = points.select("label", F.posexplode("vec").alias("d", "v")).groupBy("label", "d").agg(
        F.avg("v").alias("m")).collect()  # ten labels
    centers = np.zeros((10, 64))
    for r in means:
        centers[r["label"], r["d"]] = r["m"]
    return neighbors.assign_nearest(points, centers).select("vec_id", "cell", "cell_dist")


_KDIST = f"""with {PLANE}, k as (select id, dist from (
  select id, dist, row_number() over (partition by id order by dist, nbr) as r from p) where r = 20)"""
_CURVE = _KDIST + """,
  o as (select dist, row_number() over (order by dist desc, id) - 1 as idx,
    (dist - min(dist) over ()) / (max(dist) over () - min(dist) over () + 1e-9::double) as y,
    1.0::double / (count(*) over () - 1) as h, count(*) over () as n from k),
  g as (select *, case when idx = 0 then (lead(y) over w - y) / h
    when idx = n - 1 then (y - lag(y) over w) / h
    else (lead(y) over w - lag(y) over w) / (2 * h) end as g from o window w as (order by idx)),
  curve as (select idx, dist, n, case when idx = 0 then (lead(g) over w - g) / h
    when idx = n - 1 then (g - lag(g) over w) / h
    else (lead(g) over w - lag(g) over w) / (2 * h) end as d2 from g window w as (order by idx))"""


@query("k_distance", _KDIST + " select id, round(dist, 6) as dist from k")
def _(spark, folder):
    return neighbors.k_distance(plane(spark, folder), "vec_id", ["x", "y"])


@query("k_distance_cells", _KDIST + " select id, round(dist, 6) as dist from k")
def _(spark, folder):
    # In the plane a point's 20 nearest lie in the lists around it: a third of them is enough.
    return neighbors.k_distance(plane(spark, folder), "vec_id", ["x", "y"], method="cells",
                                n_cells=24, probes=8)


@query("distance_curve", _CURVE + """ select cast(idx as bigint) as idx, round(dist, 3) as dist,
  round(d2, 3) as d2 from curve""", digits=3)
def _(spark, folder):
    return neighbors.distance_curve(
        neighbors.k_distance(plane(spark, folder), "vec_id", ["x", "y"]))


@query("suggest_eps", _CURVE + """ select round(dist, 6) as eps, cast(idx as bigint) as idx
  from curve where idx < n // 2 order by d2 desc, idx limit 1""")
def _(spark, folder):
    return neighbors.suggest_eps(neighbors.distance_curve(
        neighbors.k_distance(plane(spark, folder), "vec_id", ["x", "y"])))


EPS, MIN_SAMPLES = 0.03, 8
_CORE = f"""{PLANE}, core as (select id, count(*) >= {MIN_SAMPLES} as is_core from p
  where dist <= {EPS}::double group by id)"""


@query("core_points", f"with {_CORE} select id, is_core from core")
def _(spark, folder):
    return density.core_points(plane(spark, folder), "vec_id", ["x", "y"], EPS, MIN_SAMPLES)


@query("dbscan", f"""with recursive {_CORE},
  near as (select p.id, p.nbr from p join core a on a.id = p.id and a.is_core
    join core b on b.id = p.nbr and b.is_core where dist <= {EPS}::double),
  reach as (select id, nbr from near union select r.id, n.nbr from reach r join near n on n.id = r.nbr),
  root as (select id, min(nbr) as root from reach group by id),
  named as (select id, dense_rank() over (order by root) - 1 as c from root),
  touch as (select p.id, min(c) as c from p join named on named.id = p.nbr
    where dist <= {EPS}::double group by p.id)
  select core.id, is_core, cast(coalesce(named.c, touch.c, -1) as int) as dbscan_cluster
  from core left join named on named.id = core.id left join touch on touch.id = core.id""")
def _(spark, folder):
    return density.dbscan(plane(spark, folder), "vec_id", ["x", "y"], EPS, MIN_SAMPLES)


def _near_edges(spark, folder):
    near = neighbors.knn(vectors(spark, folder), "vec_id", "vec", 1)
    return near.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))


@query("components", f"""with recursive {PAIRS},
  near as (select id, arg_min(nbr, (dist, nbr)) as nbr from p group by id),
  link as (select id, nbr from near union select nbr, id from near),
  reach as (select id, nbr from link union select r.id, l.nbr from reach r join link l on l.id = r.nbr)
  select id, min(nbr) as component from (from reach union select id, id from e) group by id""")
def _(spark, folder):
    nodes = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"))
    return graph.components(_near_edges(spark, folder), nodes)


_GRAPH = """e as (select vec_id as id, label, embedding::double[] as r from embeddings),
u as (select id, label, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) as v from e),
p as (select a.id, b.id as nbr, list_distance(a.v, b.v) as dist from u a join u b on a.id <> b.id),
k as (select * from (select *, row_number() over (partition by id order by dist, nbr) as r from p)
  where r <= 10),
g as (select least(id, nbr) as src, greatest(id, nbr) as dst,
  max(least(greatest(1 - dist * dist / 2, 0.0::double), 1.0::double)) as weight from k group by 1, 2
  having weight > 0)"""


@query("knn_graph", f"with {_GRAPH} select src, dst, round(weight, 6) as weight from g")
def _(spark, folder):
    return graph.knn_graph(vectors(spark, folder), "vec_id", "vec")


@query("modularity", f"""with {_GRAPH},
  ends as (select a.label as ca, b.label as cb, weight from g join e a on a.id = src
    join e b on b.id = dst),
  d as (select c, sum(weight) as d from (select ca as c, weight from ends
    union all select cb, weight from ends) group by 1),
  l as (select ca as c, sum(weight) as l from ends where ca = cb group by 1),
  m as (select sum(weight) as m from g)
  select round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) as q
  from d left join l using (c), m""")
def _(spark, folder):
    points = vectors(spark, folder)
    return graph.modularity(cut(graph.knn_graph(points, "vec_id", "vec")),
                            points.select(F.col("vec_id").alias("id"), "label"), "label")


@query("louvain")
def _(spark, folder):
    points = vectors(spark, folder)
    edges = cut(graph.knn_graph(points, "vec_id", "vec"))
    return graph.louvain(edges, points.select(F.col("vec_id").alias("id")))


@query("silhouette", f"""with {PAIRS},
  s as (select p.id, a.label, b.label as other, sum(dist) as total, count(*) as n from p
    join e a on a.id = p.id join e b on b.id = p.nbr group by all),
  ab as (select id, label, max(case when other = label then total / n end) as a,
    min(case when other <> label then total / n end) as b from s group by 1, 2)
  select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from ab""")
def _(spark, folder):
    return neighbors.silhouette(vectors(spark, folder), "vec_id", "vec", "label", None)


@query("silhouette_squared", f"""with {PAIRS},
  s as (select p.id, a.label, b.label as other, sum(dist * dist) as total, count(*) as n from p
    join e a on a.id = p.id join e b on b.id = p.nbr group by all),
  ab as (select id, label, max(case when other = label then total / n end) as a,
    min(case when other <> label then total / n end) as b from s group by 1, 2)
  select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from ab""")
def _(spark, folder):
    return neighbors.silhouette(vectors(spark, folder), "vec_id", "vec", "label", method="squared")


@query("sweep_k", digits=4)
def _(spark, folder):
    return cluster.sweep_k(vectors(spark, folder), "vec", id_col="vec_id")


@query("sweep_k_inertia", "select cast(range as int) as k, true as falls from range(2, 11)")
def _(spark, folder):
    # Every further centre lowers the cost of the best of ten runs, and none exceeds the total.
    points = cut(vectors(spark, folder))
    costs = cluster.sweep_k(points, "vec", id_col="vec_id").collect()
    total = fit_many(points, "vec", [(1, 0)], 2, "vec_id")[0].cost
    before = [total] + [r["inertia"] for r in costs[:-1]]
    return spark.createDataFrame([(r["k"], r["inertia"] < b) for r, b in zip(costs, before)],
                                 "k int, falls boolean")


@query("kmeans")
def _(spark, folder):
    out, _ = cluster.kmeans(vectors(spark, folder), "vec", 5, id_col="vec_id")
    return out.select("vec_id", "cluster")


@query("kmeans_fixed_point", """select count(*) as n_rows, 5 as n_clusters, true as settled,
  true as nearest, true as cost_agrees from embeddings""")
def _(spark, folder):
    # One more step from the returned grouping: no mean moves, no row changes, the cost is the same.
    out, fit = cluster.kmeans(cut(vectors(spark, folder)), "vec", 5, id_col="vec_id")
    out = cut(out)
    cells = out.select("cluster", F.posexplode("vec").alias("d", "v"))
    means = cells.groupBy("cluster", "d").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"),
                                              F.count("*").alias("n")).collect()
    found = np.zeros_like(fit.centers)
    for r in means:  # one row per centre and dimension
        found[r["cluster"], r["d"]] = r["m"]
    gap = np.sqrt(((found[:, None] - fit.centers[None]) ** 2).sum(axis=2)).min(axis=1).max()
    cost = sum(r["s"] * r["n"] for r in means)
    placed = neighbors.assign_nearest(out, found)
    return placed.agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster").cast("int").alias("n_clusters"),
        F.lit(bool(gap <= TOLERANCE)).alias("settled"),
        (F.count_if(F.col("cell") != F.col("cluster")) == 0).alias("nearest"),
        F.lit(bool(abs(cost - fit.cost) <= 1e-6 * cost)).alias("cost_agrees"))


@query("ward")
def _(spark, folder):
    return cluster.ward(vectors(spark, folder), "vec", 5, id_col="vec_id").select(
        "vec_id", "agg_cluster")


@query("ward_rows")
def _(spark, folder):
    return cluster.ward(vectors(spark, folder), "vec", 5, id_col="vec_id", method="rows").select(
        "vec_id", "agg_cluster")


# Ward's heights add up to the whole variance, whatever the tree; copies merge at height zero.
@query("ward_tree", """
  select (select count(distinct embedding) from embeddings) as n_leaves,
    (select count(distinct embedding) - 1 from embeddings) as n_merges, true as rising,
    round(sum(q - s * s / n), 4) as total
  from (select i, sum(x * x) as q, sum(x) as s, count(*) as n
    from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i
      from embeddings) group by i)""", digits=4)
def _(spark, folder):
    leaves, merges = hierarchy.ward_tree(vectors(spark, folder), "vec")
    up = merges.select(F.explode(F.array("a", "b")).alias("parent"), F.col("height").alias("above"))
    falls = merges.join(up, "parent").where(F.col("height") > F.col("above"))
    return merges.agg(
        F.lit(leaves.count()).alias("n_leaves"), F.count("*").alias("n_merges"),
        F.lit(falls.isEmpty()).alias("rising"), F.sum("height").alias("total"))


def _ari_sql(source: str, a: str, b: str) -> str:
    return f"""(with t as (select {a} as a, {b} as b, count(*)::double as n from {source} group by all),
      s as (select (select sum(n * (n - 1) / 2) from t) as ab,
        (select sum(n * (n - 1) / 2) from (select sum(n) as n from t group by a)) as a,
        (select sum(n * (n - 1) / 2) from (select sum(n) as n from t group by b)) as b,
        (select sum(n) * (sum(n) - 1) / 2 from t) as al)
      select (ab - a * b / al) / ((a + b) / 2 - a * b / al) from s)"""


@query("adjusted_rand",
       f"select round({_ari_sql('orders', 'o_orderpriority', 'o_orderstatus')}, 6) as ari")
def _(spark, folder):
    return compare.adjusted_rand(table(spark, folder, "orders"), "o_orderpriority",
                                 "o_orderstatus")


@query("compare_methods", f"""
  select 'a' as method, 'clusters' as measure, count(distinct label)::double as value from embeddings
  union all select 'b', 'clusters', count(distinct vec_id % 3)::double from embeddings
  union all select 'c', 'clusters', count(distinct case when label > 0 then label end)::double
    from embeddings
  union all select 'a vs b', 'ari', round({_ari_sql('embeddings', 'label', 'vec_id % 3')}, 6)
  union all select 'a vs c', 'ari', round({_ari_sql('embeddings', 'label', 'label - 1')}, 6)
  union all select 'b vs c', 'ari', round({_ari_sql('embeddings', 'vec_id % 3', 'label - 1')}, 6)
  """)
def _(spark, folder):
    marked = vectors(spark, folder).select("label", (F.col("vec_id") % 3).alias("third"),
                                           (F.col("label") - 1).alias("shifted"))
    return compare.compare_methods(marked, {"a": "label", "b": "third", "c": "shifted"}, {})


# ---------------------------------------------------------------- topics and labels

@query("topic_vocabulary", _sql("""
  , s as (select cluster, count(*) as n from reviews group by 1),
  t as (select cluster, term, cast(sum(tf) as bigint) as cf, count(*) as df from counted group by all),
  r as (select t.*, cast(row_number() over (partition by t.cluster order by cf desc, term) as int)
    as rank from t join s on s.cluster = t.cluster where df >= 2 and df <= 0.9::double * n)
  select cluster, rank, term, cf, df from r where rank <= 2000""", COUNTED))
def _(spark, folder):
    return topics.group_vocabularies(staged(spark, folder, "Id", "cluster", "clean_text"))


@query("topics")
def _(spark, folder):
    found, _ = topics.topics_per_group(staged(spark, folder, "Id", "cluster", "clean_text"))
    return found.withColumn("top_words", F.array_join("top_words", " "))


@query("topic_grid", _sql("""
  , t as (select cluster, "Quarter" - 1 as s, array_to_string(
      arg_min(string_split(clean_text, ' '), Id)[1:6], ' | ') as w from reviews group by 1, 2)
  select concat('C', cluster) as cluster, """ + ", ".join(
    f"coalesce(max(case when s = {i} then w end), '') as T{i}" for i in range(4)) +
    " from t group by 1"))
def _(spark, folder):
    # The words of each cluster's first review in a quarter stand for a topic's words.
    found = clean(spark, folder).groupBy(
        "cluster", (F.col("Quarter") - 1).alias("sub_topic")).agg(
            F.min_by(F.split("clean_text", " "), "Id").alias("top_words"))
    return topics.topic_grid(found)


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("label_prompts", _sql(_LABEL_TERMS + f"""
  , few as (select * from (select *, row_number() over (partition by cluster order by {_drawn('Id')})
      as rn from reviews) where rn <= 3),
  quotes as (select cluster, string_agg(concat('  - [', Score, '★] "', substr(Text, 1, 200), '..."'),
      chr(10) order by rn) as q from few group by 1),
  cards as (select cluster, count(*) as n, avg(Score) as r from reviews group by 1)
  select cards.cluster, concat({_text_sql(PROMPT_HEAD.format(subject="product reviews"))},
    'Cluster ', cards.cluster, ' info:', chr(10), '- Reviews: ', format('{{:,}}', n),
    '  |  Avg rating: ', format('{{:.2f}}', r), '/5.0', chr(10), '- Top terms: ',
    array_to_string(terms, ', '), chr(10), '- Sample reviews:', chr(10), q,
    {_text_sql(PROMPT_TAIL)}) as prompt
  from cards join label_terms using (cluster) join quotes using (cluster)""", COUNTED))
def _(spark, folder):
    return labels.label_prompts(staged(
        spark, folder, "Id", "cluster", "Score", "Summary", "Text", "clean_text", "word_count"))


@query("parse_labels", """select doc_id as cluster,
  case when doc_id % 3 = 2 then 'Unknown' else source end as label,
  case when doc_id % 3 = 2 then 'unparseable response' when doc_id % 3 = 0 then lang end
    as description,
  case when doc_id % 3 = 2 then 'Unknown' else cast(n_chars as varchar) end as sentiment
  from documents""")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    kind = F.col("doc_id") % 3
    full = F.to_json(F.struct(F.col("source").alias("label"),
                              F.when(kind == 0, F.col("lang")).alias("description"),
                              F.col("n_chars").cast("string").alias("sentiment")))
    fenced = F.concat(F.lit("```json\n"), full, F.lit("\n```"))
    return labels.parse_labels(docs.select(
        F.col("doc_id").alias("cluster"),
        F.when(kind == 2, F.concat(F.lit("sorry: "), full)).when(kind == 1, fenced)
        .otherwise(full).alias("response")))


@query("attach_labels", _sql("""select Id, r.cluster,
  coalesce(case when r_regionkey < 4 then r_name end, concat('C', r.cluster)) as cluster_label,
  coalesce(case when r_regionkey in (1, 2) then lower(r_name) end, '') as cluster_description,
  '' as cluster_sentiment from raw r left join region on r_regionkey = r.cluster""", RAW))
def _(spark, folder):
    regions = table(spark, folder, "region").where(F.col("r_regionkey") < 4).select(
        F.col("r_regionkey").cast("int").alias("cluster"), F.col("r_name").alias("label"),
        F.when(F.col("r_regionkey").isin(1, 2), F.lower("r_name")).alias("description"),
        F.lit(None).cast("string").alias("sentiment"))
    return labels.attach_labels(raw(spark, folder).select("Id", "cluster"), regions)


@query("sample_reviews", _sql(f"""select Id, cluster, Score, Summary, substr(Text, 1, 220) as Text
  from (select *, row_number() over (partition by cluster order by {_drawn('Id')}) as rn
    from reviews) where rn <= 2"""))
def _(spark, folder):
    return labels.sample_reviews(clean(spark, folder))
