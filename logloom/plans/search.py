"""Search queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from .registry import query

col = F.col
_TOK = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_DOCS = f"d as (select *, {_TOK.format('text')} as w from documents)"


@query("b30_term_search", f"with {_DOCS}, h as (select doc_id, lang from d where list_has_all(w, ['the', 'that'])) select *, (select count(*) from h) as total_hits from (select * from h order by doc_id limit 20 offset 10)")
def term_search(t):
    hits = search.term_search(t.heavy.documents, "text", "That the")
    total = search.total_hits(hits).scalar()
    return hits.select("doc_id", "lang").orderBy("doc_id").offset(10).limit(20).withColumn("total_hits", total)


@query("b31_filter_expression", "select doc_id from documents where lang = 'en' and n_chars >= 500 and source in (select source from documents group by source having count(*) > 40)")
def filter_expression(t):
    common = t.documents.groupBy("source").agg(F.count("*").alias("n")).where("n > 40").select("source")
    return t.documents.where((col("lang") == "en") & (col("n_chars") >= 500)).join(common, "source", "left_semi").select("doc_id")


@query("b32_multi_key_sort", "select doc_id, lang, n_chars from documents order by lang desc, n_chars desc, doc_id limit 100")
def multi_key_sort(t):
    return t.documents.select("doc_id", "lang", "n_chars").orderBy(F.desc("lang"), F.desc("n_chars"), "doc_id").limit(100)


@query("b33_facets", f"with {_DOCS} select 'lang' as facet, lang as value, count(*) as n from d where list_contains(w, 'the') group by lang union all select 'source', source, count(*) from d where list_contains(w, 'the') group by source")
def facets(t):
    return search.facets(search.term_search(t.heavy.documents, "text", "the"), ["lang", "source"])


@query("b34_highlight", r"""select doc_id, regexp_replace(text, '(?i)(^|[^\p{L}\p{N}])(that|the)([^\p{L}\p{N}]|$)', '\1<em>\2</em>\3', 'g') as marked from
  (select doc_id, regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g') as text from documents)""")
def highlight(t):
    # gaps are doubled so that neighbouring matches do not share one, as the SQL needs
    doubled = F.regexp_replace("text", r"([^\p{L}\p{N}])", "$1$1")
    return t.heavy.documents.select("doc_id", search.highlight(doubled, ["the", "that"]).alias("marked"))


@query("b35_crop", """select doc_id, case when s > 1 then '…' else '' end || substring(text, s, 60) || case when s + 60 <= length(text) then '…' else '' end as cropped
  from (select doc_id, text, greatest(1, greatest(strpos(lower(text), 'that'), 1) - 30) as s from documents)""")
def crop(t):
    return t.heavy.documents.select("doc_id", search.crop(col("text"), "that", 60).alias("cropped"))


def _cost_sql(words, term, typos):
    return f"list_min(list_transform(list_filter({words}, lambda x: abs(length(x) - {len(term)}) <= {typos} and levenshtein(x, '{term}') <= {typos}), lambda x: levenshtein(x, '{term}')))"


@query("b36_typo_tolerance", f"with {_DOCS} select doc_id, cast(a + b as integer) as typos from (select doc_id, {_cost_sql('w', 'thesened', 1)} as a, {_cost_sql('w', 'that', 0)} as b from d) where a is not null and b is not null")
def typo_tolerance(t):
    return search.fuzzy_search(t.heavy.documents, "text", "thesened that").select("doc_id", "typos")


@query("b37_stop_words_synonyms", f"with {_DOCS} select doc_id from d where list_has_any(w, ['elle', 'der', 'quevi']) and list_has_any(w, ['le', 'that'])")
def stop_words_synonyms(t):
    return search.synonym_search(t.heavy.documents, "text", "the elle that", {"elle": ["der", "quevi"], "that": ["le"]}, {"the"}).select("doc_id")


@query("b38_distinct_attribute", f"with {_DOCS} select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from d where list_contains(w, 'the')) where rn = 1")
def distinct_attribute(t):
    hits = search.term_search(t.heavy.documents, "text", "the").select("source", "doc_id", "n_chars")
    return search.distinct_attribute(hits, "source", [F.desc("n_chars"), col("doc_id")])


_PLACES = "list_filter(range(1, len(w) + 1), lambda i: w[i] = '{}')"
_RANK = f"""{_DOCS}, c as (select doc_id, n_chars, {_cost_sql('w', 'heention', 1)} as c1, {_cost_sql('w', 'that', 0)} as c2, {_PLACES.format('heention')} as l1, {_PLACES.format('that')} as l2 from d),
  k as (select doc_id, n_chars, cast((c1 is not null)::integer + (c2 is not null)::integer as integer) as words, cast(coalesce(c1, 0) + coalesce(c2, 0) as integer) as typo,
    cast(list_min(list_transform(l1, lambda a: list_min(list_transform(l2, lambda b: abs(a - b))))) - 1 as integer) as proximity,
    cast(list_min(list_concat(l1, l2)) as integer) as attribute, cast((coalesce(c1, 9) = 0)::integer + (coalesce(c2, 9) = 0)::integer as integer) as exactness from c)"""


@query("b39_ranking", f"with {_RANK} select doc_id, words, typo, proximity, attribute, exactness from k where words > 0 order by words desc, typo, proximity nulls last, attribute nulls last, n_chars desc, exactness desc, doc_id limit 100")
def ranking(t):
    return search.ranked(t.heavy.documents.select("doc_id", "n_chars", "text"), "text", "heention that", 100, [F.desc("n_chars")], "doc_id").select("doc_id", "words", "typo", "proximity", "attribute", "exactness")


@query("b39_tf_idf", f"""with {_DOCS}, c as (select doc_id, len(list_filter(w, lambda x: x = 'that')) as a, len(list_filter(w, lambda x: x = 'elle')) as b from d),
  n as (select count(*) as n, count(*) filter (where a > 0) as na, count(*) filter (where b > 0) as nb from c)
  select doc_id, round(case when a > 0 then a * ln(1 + n.n / na) else 0 end + case when b > 0 then b * ln(1 + n.n / nb) else 0 end, 6) as score from c, n where a > 0 or b > 0""")
def tf_idf(t):
    return search.tf_idf(t.heavy.documents, "doc_id", "text", "that elle").select("doc_id", F.round("score", 6).alias("score"))


@query("b40_multi_index", f"""select 'documents' as index, cast(doc_id as varchar) as key from documents where list_contains({_TOK.format('text')}, 'that') union all select 'pages', cast(page_id as varchar) from pages where list_contains({_TOK.format('html')}, 'that')
  union all select 'conversations', conv_id || '/' || turn from conversations where list_contains({_TOK.format('text')}, 'that')""")
def multi_index(t):
    talks = t.heavy.conversations.withColumn("key", F.concat_ws("/", col("conv_id").cast("string"), col("turn").cast("string")))
    return search.multi_search({"documents": (t.heavy.documents, "doc_id", "text"), "pages": (t.heavy.pages, "page_id", "html"), "conversations": (talks, "key", "text")}, "that")


@query("b41_geo_radius", """select c_custkey, round(m, 3) as distance_m from (select c_custkey, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.1) / 2), 2) + cos(radians(lat)) * cos(radians(48.1)) * pow(sin(radians(lon - 11.5) / 2), 2)))) as m
  from (select c_custkey, 40 + (c_custkey * 37 % 1000) / 50.0 as lat, 5 + (c_custkey * 91 % 1000) / 60.0 as lon from customer)) where m <= 300000""")
def geo_radius(t):
    k = col("c_custkey")
    places = t.customer.select("c_custkey", (40 + (k * 37 % 1000) / F.lit(50.0)).alias("lat"), (5 + (k * 91 % 1000) / F.lit(60.0)).alias("lon"))
    return search.within_radius(places, "lat", "lon", 48.1, 11.5, 300000.0).select("c_custkey", F.round("distance_m", 3).alias("distance_m"))
