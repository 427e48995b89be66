"""The registered queries: each operator on the test tables, and the same in SQL.

``V`` is the distinct part names (adjective and noun, hence full of analogies);
``T`` the commonest tokens of the documents of a language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetrad.functions import strings as S
from tetrad.functions.solver import solve_analogy, verify_analogy
from tetrad.operators import analogies, cliques, clusters, features, grids, levels, neural, rules, transfer, windows
from tetrad.operators.grids import kept
from tetrad.sources import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- inputs --------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def names(spark: SparkSession, d: str) -> DataFrame:
    return text.word_list(table(spark, d, "part"), "p_name")


def tokens(spark: SparkSession, d: str, n: int, lang: str | None = "en") -> DataFrame:
    """(lang, word, n): the n commonest tokens of each language, ties by token; a
    top-n report by definition."""
    docs = table(spark, d, "documents")
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return windows.first_n(counted, ["lang"], [F.desc("n"), "word"], n)


def every_token(spark: SparkSession, d: str) -> DataFrame:
    """(lang, word, n): all tokens of all languages."""
    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def all_words(spark: SparkSession, d: str) -> DataFrame:
    """(word): the distinct tokens of all languages."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.distinct()


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Parts as (id, lemma, form, msd)."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("lemma"), F.col("p_name").alias("form"), F.concat_ws(";", "p_type", "p_brand").alias("msd"), F.col("p_brand").alias("brand"))


def ratios(spark: SparkSession, d: str) -> DataFrame:
    return clusters.raw_clusters(features.representatives(features.char_vectors(names(spark, d))))


V = "v as (select distinct trim(p_name) w from part where trim(p_name) <> '')"
ALPHA = "alpha as (select list(c order by c) a from (select distinct unnest(string_split(w, '')) c from v))"
VEC = "vec as (select w, list_transform(a, lambda c: length(w) - length(replace(w, c, ''))) x from v, alpha)"
REP = "rep as (select x, min(w) w from vec group by x)"
PAIR = "pair as (select l.w a, r.w b, array_to_string(list_transform(list_zip(l.x, r.x), lambda z: z[1] - z[2]), ',') id from rep l join rep r on l.x < r.x)"
RAW = "raw as (select id cluster_id, count(*) over (partition by id) size, a, b from pair qualify size >= 2)"
CORE = f"with {V}, {ALPHA}, {VEC}, {REP}, {PAIR}, {RAW}"


#: All tokens of all languages, and the distinct words among them.
ALL = "t as (select lang, w word, count(*) n from (select lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) w from documents) group by lang, w)"
WORDS = f"{ALL.replace('t as', 'every as', 1)}, t as (select distinct word from every)"
ACORE = f"{WORDS}, v as (select word w from t), {ALPHA}, {VEC}"


def top(n: int, lang: str | None = "en") -> str:
    where = f"where lang = '{lang}'" if lang else ""
    return f"t as (select lang, w word, count(*) n from (select lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) w from documents {where}) group by lang, w qualify row_number() over (partition by lang order by count(*) desc, w) <= {n})"


GRAM = "list_sort(string_split({0}, ''))"


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence: rows of the usual table, each a running maximum."""
    same = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: (x = y)::int))"
    row = "list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(above[k], coalesce(above[k - 1], 0) + m[k]))))::int[]"
    return f"coalesce(list_max(list_reduce([list_transform(string_split({b}, ''), lambda y: 0)] || {same}, lambda above, m: {row})), 0)"


def far_sql(a: str, b: str) -> str:
    return f"(length({a}) + length({b}) - 2 * {lcs_sql(a, b)})::int"


TCORE = f"{top(2000)}, v as (select word w from t), {ALPHA}, {VEC}"

# ---- sources and features --------------------------------------------------------


@query(f"with {V} select w word from v")
def word_list(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d)


@query(f"with {V} select distinct unnest(string_split(w, '')) ch from v")
def alphabet_dim(spark: SparkSession, d: str) -> DataFrame:
    return features.alphabet(names(spark, d))


@query(f"with {V} select w word, ch, count(*) n from (select w, unnest(string_split(w, '')) ch from v) group by w, ch")
def char_count_long(spark: SparkSession, d: str) -> DataFrame:
    return features.char_counts(names(spark, d))


@query(f"with {V}, {ALPHA}, {VEC} select w word, array_to_string(x, ',') v from vec")
def char_vectors(spark: SparkSession, d: str) -> DataFrame:
    return features.char_vectors(names(spark, d)).select("word", F.array_join("v", ",").alias("v"))


TOK = "tok as (select list(c order by c) a from (select distinct unnest(string_split(w, ' ')) c from v))"
TVEC = "tvec as (select w, list_transform(a, lambda c: len(list_filter(string_split(w, ' '), lambda y: y = c))) x from v, tok)"


@query(f"with {V}, {TOK}, {TVEC} select w word, array_to_string(x, ',') v from tvec")
def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    return features.token_vectors(names(spark, d)).select("word", F.array_join("v", ",").alias("v"))


@query(f"with {V}, {ALPHA}, {VEC}, {TOK}, {TVEC} select w word, array_to_string(vec.x || tvec.x, ',') v from vec join tvec using (w)")
def vector_concat(spark: SparkSession, d: str) -> DataFrame:
    words = names(spark, d)
    return features.concatenated(features.char_vectors(words), features.token_vectors(words)).select("word", F.array_join("v", ",").alias("v"))


MSD = "m as (select p_partkey id, p_type lemma, p_name form, p_type || ';' || p_brand msd, p_brand brand from part)"


@query(f"with {MSD}, f as (select list(c order by c) a from (select distinct unnest(string_split(msd, ';')) c from m)) select form word, array_to_string(list_transform(a, lambda c: (list_contains(string_split(msd, ';'), c))::int), ',') v from m, f")
def tag_features(spark: SparkSession, d: str) -> DataFrame:
    return features.tag_vectors(tagged(spark, d)).select("word", F.array_join("v", ",").alias("v"))


@query(f"with {MSD}, f as (select list(c order by c) a from (select distinct unnest(string_split(msd, '')) c from m)) select form word, array_to_string(list_transform(a, lambda c: length(msd) - length(replace(msd, c, ''))), ',') v from m, f")
def tag_characters(spark: SparkSession, d: str) -> DataFrame:
    return features.tag_vectors(tagged(spark, d), mode="char").select("word", F.array_join("v", ",").alias("v"))


@query(f"with {MSD}, f as (select list(distinct lemma order by lemma) a from m) select form word, array_to_string(list_transform(a, lambda c: (lemma = c)::int), ',') v from m, f")
def lemma_features(spark: SparkSession, d: str) -> DataFrame:
    return features.lemma_vectors(tagged(spark, d)).select("word", F.array_join("v", ",").alias("v"))


@query(f"with {MSD} select form word, array_to_string(string_split(msd, ';'), ',') feats from m union all select distinct lemma, 'LEMMA=YES' from m")
def forms_and_lemmas(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).withColumn("feats", F.split("msd", ";"))
    return text.forms_and_lemmas(rows).select("word", F.array_join("feats", ",").alias("feats"))


@query(f"with {MSD} select id, lemma, form, msd from m qualify row_number() over (partition by form order by id desc) = 1")
def last_of_each_form(spark: SparkSession, d: str) -> DataFrame:
    return text.last_of_each_form(tagged(spark, d), "id").select("id", "lemma", "form", "msd")


@query(f"with {V}, o as (select distinct p_type w from part), alpha as (select list(c order by c) a from (select distinct unnest(string_split(w, '')) c from (from v union all from o))) select w word, array_to_string(list_transform(a, lambda c: length(w) - length(replace(w, c, ''))), ',') v from o, alpha")
def shared_alphabet(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "part").select(F.col("p_type").alias("word")).distinct()
    letters = features.symbols(features.alphabet(names(spark, d).union(other)), "ch")
    return features.char_vectors(other, letters).select("word", F.array_join("v", ",").alias("v"))


@query(f"with {V}, {ALPHA}, codes as (select list(b order by bit_count(b::utinyint), b) c from range(256) t(b)), r as (select w, list_transform(string_split(w, ''), lambda x: c[list_position(a, x)]) k from v, alpha, codes) select w word, array_to_string(list_transform(range(8), lambda i: list_sum(list_transform(k, lambda y: (y >> i) & 1))::int), ',') v from r")
def bit_vectors(spark: SparkSession, d: str) -> DataFrame:
    words = names(spark, d)
    ranks = {c: i for i, c in enumerate(features.symbols(features.alphabet(words), "ch"))}
    return words.select("word", F.array_join(S.bit_vector("word", ranks), ",").alias("v"))


@query(f"with {ACORE} select min(w) rep, string_agg(w, ' ' order by w) members from vec group by x")
def indistinguishables(spark: SparkSession, d: str) -> DataFrame:
    classes = features.anagrams(all_words(spark, d))
    return classes.select("rep", F.array_join("members", " ").alias("members"))


@query(f"with {ACORE}, g as (select x, string_agg(w, ' ' order by w) m from vec group by x) select w word, m members from vec join g using (x)")
def equivalents_of_word(spark: SparkSession, d: str) -> DataFrame:
    found = features.equivalents(None, features.anagrams(all_words(spark, d)))
    return found.select("word", F.array_join("members", " ").alias("members"))


@query(f"with {WORDS} select word, array_to_string(list_sort(string_split(word, '')), '') alphagram from t")
def alphagrams(spark: SparkSession, d: str) -> DataFrame:
    return all_words(spark, d).select("word", S.alphagram("word").alias("alphagram"))


@query(f"with {WORDS} select array_to_string(list_sort(string_split(word, '')), '') alphagram, string_agg(word, ' ' order by word) keys from t group by 1")
def inverse_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = all_words(spark, d).select("word", S.alphagram("word").alias("alphagram"))
    return features.inverse(rows, "word", "alphagram").select("alphagram", F.array_join("keys", " ").alias("keys"))


@query(f"with {V}, voc as (select list(c order by c) a from (select distinct unnest(string_split(w, '')) c from v where w like '%r%')) select w word, array_to_string(list_transform(string_split(w, ''), lambda c: coalesce(list_position(a, c), 0) - 1), ',') ids from v, voc")
def encode_words(spark: SparkSession, d: str) -> DataFrame:
    words = names(spark, d)
    voc = features.symbols(features.alphabet(words.where("word like '%r%'")), "ch")
    return words.select("word", F.array_join(F.transform(S.encode("word", voc), lambda i: i.cast("string")), ",").alias("ids"))


@query(f"with {V}, voc as (select list(c order by c) a from (select distinct unnest(string_split(w, '')) c from v)) select w word, array_to_string(list_append(list_prepend(len(a), list_transform(string_split(w, ''), lambda c: list_position(a, c) - 1)), len(a) + 1), ',') ids from v, voc")
def encode_words_with_marks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the letters, between those of a begin and of an end."""
    words = names(spark, d)
    voc = features.symbols(features.alphabet(words), "ch")
    return words.select("word", F.array_join(F.transform(S.encode("word", voc, marks=True), lambda i: i.cast("string")), ",").alias("ids"))


@query(f"with {V} select w word, w decoded from v")
def decode_words(spark: SparkSession, d: str) -> DataFrame:
    words = names(spark, d)
    voc = features.symbols(features.alphabet(words), "ch")
    return words.select("word", S.decode(S.encode("word", voc, marks=True), voc).alias("decoded"))


@query(f"with {V} select ch, (row_number() over (order by ch) - 1)::int id from (select distinct unnest(string_split(w, '')) ch from v)")
def character_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return features.vocabulary(names(spark, d)).select("ch", F.col("id").cast("int").alias("id"))


@query(f"with {ALL} select lang, word, not regexp_matches(word, '[^\\x00-\\x7F]') is_ascii, regexp_replace(word, '[^\\x00-\\x7F]', '?', 'g') masked, strlen(word) utf8_bytes from t")
def ascii_checks(spark: SparkSession, d: str) -> DataFrame:
    t = every_token(spark, d)
    return t.select("lang", "word", S.is_ascii("word").alias("is_ascii"), S.mask_non_ascii("word").alias("masked"), S.utf8_size("word").cast("long").alias("utf8_bytes"))


@query("select event_id, (event_id // 3600) || ':' || lpad(((event_id // 60) % 60)::varchar, 2, '0') || ':' || lpad((event_id % 60)::varchar, 2, '0') t, case event_id % 7 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then true when 5 then false end::boolean truth from events")
def durations(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("yes", "No", "T", "n", "1", "0", "maybe")]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.duration("event_id").alias("t"), S.truth(said).alias("truth"))


# ---- clusters ----------------------------------------------------------------------


@query(f"{CORE} select a, b, id from pair")
def analogy_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = features.representatives(features.char_vectors(names(spark, d)))
    return clusters.ratio_pairs(v).select("a", "b", F.array_join("d", ",").alias("id"))


@query(f"{CORE} select cluster_id, size, a, b from raw")
def raw_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ratios(spark, d)


@query(f"{CORE} select size, count(*) freq from (select cluster_id, count(*) size from raw group by cluster_id) group by size")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.statistics(ratios(spark, d))


@query(f"with {V}, {ALPHA}, {VEC}, {REP}, pair as (select l.w a, r.w b, array_to_string(list_transform(list_zip(l.x, r.x), lambda z: z[1] - z[2]), ',') id from rep l, rep r where l.w < 'm' and r.w >= 'm'), {RAW} select cluster_id, size, a, b from raw")
def cross_file_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = features.representatives(features.char_vectors(names(spark, d)))
    return clusters.raw_clusters(v.where("word < 'm'"), other=v.where("word >= 'm'"))


@query(f"{CORE}, f as (select min(w) w from rep) select cluster_id, size, a, b from raw where cluster_id in (select cluster_id from raw, f where {GRAM.format('a')} = {GRAM.format('w')} or {GRAM.format('b')} = {GRAM.format('w')})")
def focus_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The word is given backwards: it is found by its letters."""
    v = features.representatives(features.char_vectors(names(spark, d)))
    return clusters.raw_clusters(v, focus=v.agg(F.min("word")).first()[0][::-1])


@query(f"{CORE} select cluster_id, size, a, b from raw where size between 3 and 20")
def max_size_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = features.representatives(features.char_vectors(names(spark, d)))
    return clusters.raw_clusters(v, least=3, most=20)


@query(f"with {TCORE}, {REP}, {PAIR}, {RAW} select size, count(*) freq from (select cluster_id, count(*) size from raw group by cluster_id) group by size")
def clusters_of_2000_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of a vocabulary, two million pairs and more."""
    return clusters.statistics(clusters.raw_clusters(features.representatives(features.char_vectors(tokens(spark, d, 2000)))))


@query(f"with {TCORE.replace(top(2000), top(5000))}, {REP}, {PAIR}, {RAW} select size, count(*) freq from (select cluster_id, count(*) size from raw group by cluster_id) group by size")
def clusters_of_5000_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of a vocabulary, twelve million pairs."""
    return clusters.statistics(clusters.raw_clusters(features.representatives(features.char_vectors(tokens(spark, d, 5000)))))


def _sizes(n: int) -> str:
    return f"with {TCORE.replace(top(2000), top(n))}, {REP}, {PAIR}, {RAW} select size, count(*) freq from (select cluster_id, count(*) size from raw group by cluster_id) group by size"


def _vocabulary(spark: SparkSession, d: str, n: int) -> DataFrame:
    """One word for each vector of the commonest English tokens."""
    return features.representatives(features.char_vectors(tokens(spark, d, n)))


TREE = "r as (select x, row_number() over (order by x) - 1 rk from (select distinct x from vec)), lv as (select rk, x, unnest(range(0, len(x) + 1)) l from r), nd as (select l, min(rk) s, count(*) c, any_value(case when l = 0 then 0 else x[l] end)::int v, bool_and(len(list_filter(x[greatest(l, 1):], lambda e: e <> 0)) = 0) rest from lv group by l, x[1:l]), num as (select *, row_number() over (order by l, s) - 1 k, s + c e from nd)"


@query(f"with {TCORE.replace(top(2000), top(5000))}, {TREE} select n.k number, n.l::int as level, n.s as start, n.e as stop, n.c size, n.v as value, n.c = 1 and n.rest empty_rest, coalesce(f.k, -1) first_child, coalesce(g.k, -1) last_child from num n left join num f on f.l = n.l + 1 and f.s = n.s left join num g on g.l = n.l + 1 and g.e = n.e")
def block_nodes_of_5000_english_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The prefix tree of a vocabulary's vectors."""
    return levels.linked(levels.nodes(_vocabulary(spark, d, 5000)))


@query(f"with {TCORE}, {REP}, {PAIR}, {RAW} select cluster_id, size, a, b from raw")
def clusters_by_levels_of_2000_english_tokens(spark: SparkSession, d: str) -> DataFrame:
    return levels.clusters(_vocabulary(spark, d, 2000))


@query()
def expanded_pairs_by_level(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of nodes the clustering of 5000 English tokens expands."""
    return levels.report(_vocabulary(spark, d, 5000))


@query(_sizes(10_000))
def clusters_of_10000_english_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of a vocabulary, ten million pairs and more, by levels."""
    return levels.sizes(_vocabulary(spark, d, 10_000))


@query()
def clusters_of_20000_english_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of a vocabulary, thirty million pairs and more, by levels."""
    return levels.sizes(_vocabulary(spark, d, 20_000))


REST = "array_to_string(list_filter(string_split({0}, ''), lambda c: length({0}) - length(replace({0}, c, '')) = length({1}) - length(replace({1}, c, ''))), '')"


@query(f"{CORE}, p as (select distinct a, b from raw), f as (select a, b, {far_sql('a', 'b')} d from p) select a, b, d, d d_arrow, {REST.format('a', 'b')} = {REST.format('b', 'a')} common_rest from f")
def lcs_distances(spark: SparkSession, d: str) -> DataFrame:
    pairs = ratios(spark, d).select("a", "b").distinct()
    return pairs.select("a", "b", S.lcs_distance("a", "b").alias("d"), S.lcs_distance_arrow("a", "b").alias("d_arrow"), S.common_rest("a", "b").alias("common_rest"))


FAR = f"{CORE}, f as (select a, b, {far_sql('a', 'b')} d from (select distinct a, b from raw))"


@query(f"{FAR} select cluster_id, d, a, b from raw join f using (a, b) qualify count(*) over (partition by cluster_id, d) >= 2")
def horizontal_split(spark: SparkSession, d: str) -> DataFrame:
    return clusters.horizontal_split(ratios(spark, d))


#: Ratios of all equivalents, split by distance, then into covering cliques of ratios whose distances agree: from each
#: ratio not yet covered, those of most agreements first, one look at all of them.
FILTERED = (
    f"{CORE}, mem as (select r.w rep, v.w member from rep r join vec v on r.x = v.x), "
    "ex as (select cluster_id, p.member a, q.member b from raw join mem p on raw.a = p.rep join mem q on raw.b = q.rep), "
    f"f as (select a, b, {far_sql('a', 'b')} d from (select distinct a, b from ex)), "
    "h as (select cluster_id, d, a, b, row_number() over (partition by cluster_id, d order by a, b) i from (select * from ex join f using (a, b) qualify count(*) over (partition by cluster_id, d) >= 2)), "
    "w2 as (select distinct x.a u, y.a w from h x join h y using (cluster_id, d) union select distinct x.b, y.b from h x join h y using (cluster_id, d)), "
    f"fw as (select u, w, {far_sql('u', 'w')} far from w2), "
    "e as (select x.cluster_id, x.d, x.i, y.i j from h x join h y on x.cluster_id = y.cluster_id and x.d = y.d and x.i <> y.i join fw s on s.u = x.a and s.w = y.a join fw t on t.u = x.b and t.w = y.b where s.far = t.far), "
    "n as (select h.cluster_id, h.d, h.i, coalesce(list(j) filter (j is not null), []) js from h left join e on e.cluster_id = h.cluster_id and e.d = h.d and e.i = h.i group by all), "
    "g as (select cluster_id, d, list(i order by len(js) desc, i) o, list(js order by i) adj from n group by cluster_id, d), "
    "c as (select cluster_id, d, list_reduce(list_prepend([]::bigint[][], list_transform(o, lambda v: [[v]])), lambda acc, x: case when list_contains(flatten(acc), x[1][1]) then acc else "
    "list_append(acc, list_reduce(list_prepend([x[1][1]], list_transform(list_filter(o, lambda w: w <> x[1][1]), lambda w: [w])), lambda m, w: case when len(list_filter(m, lambda u: list_contains(adj[u], w[1]))) = len(m) then list_append(m, w[1]) else m end)) end) cliques from g), "
    "p as (select cluster_id, d, k - 1 k, list_sort(big[k]) m from (select cluster_id, d, list_filter(cliques, lambda m: len(m) >= 2) big from c), lateral (select unnest(range(1, len(big) + 1)) k)), "
    "s as (select p.cluster_id, p.d, k || ':' || z.a || ' : ' || z.b part, h.a, h.b from p join h z on z.cluster_id = p.cluster_id and z.d = p.d and z.i = m[1] join h on h.cluster_id = p.cluster_id and h.d = p.d and list_contains(m, h.i)), "
    "once as (select * from s qualify count(*) over (partition by cluster_id, d, part, a) = 1 and count(*) over (partition by cluster_id, d, part, b) = 1), "
    "filtered as (select cluster_id || '|' || d || '|' || part cluster_id, a, b from once qualify count(*) over (partition by cluster_id, d, part) >= 2)"
)


@query(f"{FILTERED} select cluster_id, a, b from filtered")
def filtered_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = features.char_vectors(names(spark, d))
    return clusters.filtered_clusters(ratios(spark, d), features.equivalence_classes(v))


@query(f"{CORE}, once as (select cluster_id, a, b from raw qualify count(*) over (partition by cluster_id, a) = 1 and count(*) over (partition by cluster_id, b) = 1) select cluster_id, a, b from once qualify count(*) over (partition by cluster_id) >= 2")
def dedupe_ratios(spark: SparkSession, d: str) -> DataFrame:
    return clusters.without_repeated_words(ratios(spark, d).drop("size"), ["cluster_id"])


@query(f"{CORE}, l as (select w from v where w like '%r%'), k as (select cluster_id, a, b from raw where a in (from l) and b in (from l)) select * from k qualify count(*) over (partition by cluster_id) > 1")
def filter_words_keep(spark: SparkSession, d: str) -> DataFrame:
    return clusters.filter_words(ratios(spark, d), names(spark, d).where("word like '%r%'"), delete=False)


@query(f"{CORE}, l as (select w from v where w like '%r%'), k as (select cluster_id, a, b from raw where a not in (from l) and b not in (from l)) select * from k qualify count(*) over (partition by cluster_id) > 1")
def filter_words_delete(spark: SparkSession, d: str) -> DataFrame:
    return clusters.filter_words(ratios(spark, d), names(spark, d).where("word like '%r%'"), delete=True)


@query(f"{CORE}, o as (select a word, b other from raw union select b, a from raw) select word, count(*)::int degree, string_agg(other, ',' order by other) partners from o group by word")
def paradigm_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return clusters.paradigm_lexicon(ratios(spark, d)).select("word", "degree", F.array_join("partners", ",").alias("partners"))


NORMAL = f"{CORE}, k as (select *, row_number() over (partition by cluster_id order by a, b) k, length(first_value(a) over o) > length(first_value(b) over o) turn from raw window o as (partition by cluster_id order by a, b)), u as (select cluster_id, size, k, case when turn then b else a end a, case when turn then a else b end b from k), two as (select x.cluster_id, x.a, x.b, y.a c, y.b d, {lcs_sql('x.a', 'x.b')} < {lcs_sql('x.a', 'y.a')} swap from u x join u y using (cluster_id) where x.size = 2 and x.k = 1 and y.k = 2)"


@query(f"{NORMAL} select cluster_id, a, b from u where size > 2 union all select cluster_id, a, case when swap then c else b end, from two union all select cluster_id, case when swap then b else c end, d from two")
def normalized_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.normalized(ratios(spark, d))


MINUS = "array_to_string(list_transform(list_sort(list_distinct(string_split({0}, ''))), lambda c: repeat(c, greatest(length({0}) - length(replace({0}, c, '')) - length({1}) + length(replace({1}, c, '')), 0))), '')"
ATTR = f"{CORE}, f1 as (select cluster_id, min((a, b)) r from raw group by cluster_id), f2 as (select cluster_id, r[1] a, r[2] b from f1), attr as (select cluster_id, {far_sql('a', 'b')} distance, {MINUS.format('a', 'b')} left_diff, {MINUS.format('b', 'a')} right_diff from f2)"


@query(f"{ATTR} select * from attr")
def cluster_attributes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.attributes(ratios(spark, d))


@query(f"{CORE} select distinct a, b, {MINUS.format('a', 'b')} left_diff, {MINUS.format('b', 'a')} right_diff from raw")
def multiset_differences(spark: SparkSession, d: str) -> DataFrame:
    pairs = ratios(spark, d).select("a", "b").distinct()
    return pairs.select("a", "b", S.multiset_minus("a", "b").alias("left_diff"), S.multiset_minus("b", "a").alias("right_diff"))


@query(f"{ATTR}, big as (select attr.* from attr where cluster_id in (select cluster_id from raw where size >= 4)) select x.cluster_id, y.cluster_id other_id from attr x join big y using (distance, left_diff, right_diff)")
def cluster_intersection(spark: SparkSession, d: str) -> DataFrame:
    r = ratios(spark, d)
    return clusters.intersection(r, r.where("size >= 4"))


TOTAL = f"{CORE}, w as (select cluster_id, a, b, a || ' : ' || b r from raw), tot as (select x.cluster_id, x.a, x.b, sum({far_sql('x.r', 'y.r')})::bigint total from w x join w y using (cluster_id) group by all), med as (select cluster_id, a, b, total, row_number() over (partition by cluster_id order by total, a, b)::int as rank from tot)"


@query(f"{TOTAL} select * from med")
def median_ratio_order(spark: SparkSession, d: str) -> DataFrame:
    return clusters.median_order(ratios(spark, d).drop("size"))


@query(f"{TOTAL}, o as (select raw.a word, '<' || med.a || '> : ' || med.b note from raw join med using (cluster_id) where rank = 1 union select raw.b, med.a || ' : <' || med.b || '>' from raw join med using (cluster_id) where rank = 1) select word, string_agg(note, ',' order by note) notes from o group by word")
def annotated_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return clusters.annotated_lexicon(ratios(spark, d)).select("word", F.array_join("notes", ",").alias("notes"))


TWO = "raw x join raw y on x.cluster_id = y.cluster_id and (x.a, x.b) < (y.a, y.b)"
AGREE = f"{far_sql('x.a', 'y.a')} = {far_sql('x.b', 'y.b')} and {far_sql('x.a', 'x.b')} = {far_sql('y.a', 'y.b')}"


@query(f"{CORE} select x.cluster_id, bool_and({AGREE}) agree from {TWO} group by x.cluster_id")
def agreeing_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.all_distances_agree(ratios(spark, d).drop("size"))


@query(f"{CORE} select x.cluster_id, x.a, x.b, sum(({far_sql('x.a', 'y.a')} <> {far_sql('x.b', 'y.b')})::int)::bigint n from raw x join raw y on x.cluster_id = y.cluster_id and (x.a, x.b) <> (y.a, y.b) group by all")
def cluster_discrepancies(spark: SparkSession, d: str) -> DataFrame:
    return clusters.discrepancies(ratios(spark, d).drop("size"))


@query(f"{CORE} select size, cluster_id, string_agg(a || ' : ' || b, ' :: ' order by a, b) value from raw group by size, cluster_id")
def cluster_sink(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.numbered(ratios(spark, d).select("cluster_id", "a", "b"), ["cluster_id"], ["a", "b"], "pos")
    return text.cluster_lines(rows).select(F.col("size").cast("long").alias("size"), "cluster_id", "value")


@query(f"{CORE} select cluster_id, a, b from raw")
def cluster_source(spark: SparkSession, d: str) -> DataFrame:
    """Written as lines and parsed again; ids are found again from the words."""
    rows = windows.numbered(ratios(spark, d).select("cluster_id", "a", "b"), ["cluster_id"], ["a", "b"], "pos")
    lines = text.cluster_lines(rows).select(F.col("value"), F.col("cluster_id").alias("id"))
    back = text.clusters(lines.select("value"))
    return back.join(lines.select(F.col("value").alias("cluster_id"), "id"), "cluster_id").select(F.col("id").alias("cluster_id"), "a", "b")


@query(f"with {V}, {ALPHA}, {VEC} select w || chr(9) || '(' || array_to_string(x, ', ') || ')' value from vec")
def vector_sink(spark: SparkSession, d: str) -> DataFrame:
    return text.vector_lines(features.char_vectors(names(spark, d)))


@query(f"with {V}, {ALPHA}, {VEC} select w word, array_to_string(x, ',') v from vec")
def vector_source(spark: SparkSession, d: str) -> DataFrame:
    back = text.vectors(text.vector_lines(features.char_vectors(names(spark, d))))
    return back.select("word", F.array_join("v", ",").alias("v"))


# ---- analogies -----------------------------------------------------------------------


SORTED = "list_sort(string_split({0}, '') || string_split({1}, ''))"
QUAD = f"quad as (select x.cluster_id, x.a a, x.b b, y.a c, y.b d from raw x join raw y on x.cluster_id = y.cluster_id and (x.a, x.b) < (y.a, y.b) where not ((x.a = x.b and y.a = y.b) or (x.a = y.a and x.b = y.b)) and {SORTED.format('x.a', 'y.b')} = {SORTED.format('x.b', 'y.a')})"


@query(f"{CORE}, {QUAD} select cluster_id, a, b, c, d from quad")
def cluster_analogies(spark: SparkSession, d: str) -> DataFrame:
    return analogies.of_clusters(ratios(spark, d), check=False)


@query(f"{CORE}, {QUAD} select cluster_id, a, b, c, d from quad where {far_sql('a', 'b')} = {far_sql('c', 'd')} and {far_sql('a', 'c')} = {far_sql('b', 'd')}")
def valid_analogies(spark: SparkSession, d: str) -> DataFrame:
    return analogies.of_clusters(ratios(spark, d))


@query(f"{CORE}, {QUAD} select a, b, c, d, {SORTED.format('a', 'd')} = {SORTED.format('b', 'c')} balance, list_bool_and(list_transform(list_distinct(string_split(a, '')), lambda x: length(a) - length(replace(a, x, '')) <= length(b) - length(replace(b, x, '')) + length(c) - length(replace(c, x, '')))) covered from quad")
def char_constraint(spark: SparkSession, d: str) -> DataFrame:
    q = analogies.of_clusters(ratios(spark, d), check=False)
    return q.select("a", "b", "c", "d", S.characters_balance("a", "b", "c", "d").alias("balance"), S.covers("a", "b", "c").alias("covered"))


PAIRS = f"{MSD}, p as (select brand, id, row_number() over (partition by brand order by id) - 1 p, {analogies.PAIRS} // count(*) over (partition by brand) k from m), ij as (select x.brand brand, x.id i, y.id j from p x join p y on x.brand = y.brand and y.p >= x.p and y.p < x.p + x.k)"
PQUAD = f"{PAIRS}, q as (select i, j, x.lemma a, x.form b, y.lemma c, y.form d from ij join m x on x.id = i join m y on y.id = j)"


@query(f"with {PAIRS} select brand, i, j from ij")
def msd_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return analogies.class_pairs(tagged(spark, d), "brand", "id")


def quads(spark: SparkSession, d: str, distinct: bool | None = None) -> DataFrame:
    rows = tagged(spark, d)
    distinct = analogies.unique(rows, "id") if distinct is None else distinct
    return analogies.of_classes(rows, "brand", "id", "lemma", "form", distinct=distinct)


def _orders(orders: tuple[str, ...], source: str) -> str:
    return " union all ".join(f"select i, j, '{o}' form, " + ", ".join(f"{o[k]} as {x}" for k, x in enumerate("abcd")) + f" from {source}" for o in orders)


@query(f"with {PQUAD} {_orders(analogies.EQUIVALENT, 'q')}")
def enrich_quads(spark: SparkSession, d: str) -> DataFrame:
    return analogies.enriched(quads(spark, d))


@query(f"with {PQUAD}, o as (select * from q where not (a = b or c = d)) {_orders(analogies.NEGATIVE, 'o')}")
def negative_quads(spark: SparkSession, d: str) -> DataFrame:
    return analogies.negatives(quads(spark, d))


@query(
    f"with {PQUAD}, e as ({_orders(analogies.EQUIVALENT, 'q')}), o as (select i, j, form \"of\", a, b, c, d from e where not (a = b or c = d)), n as ("
    + " union all ".join(f"select i, j, \"of\", '{o}' form, " + ", ".join(f"{o[k]} as {x}" for k, x in enumerate("abcd")) + " from o" for o in analogies.NEGATIVE)
    + ") select i, j, \"of\", form, a, b, c, d from n qualify row_number() over (partition by i, j order by md5(\"of\" || '|' || form || '|' || i || '|' || j || '|0'), \"of\", form, i, j) <= 8"
)
def balanced_negatives(spark: SparkSession, d: str) -> DataFrame:
    distinct = analogies.unique(tagged(spark, d), "id")
    return analogies.balanced_negatives(quads(spark, d, distinct), ["i", "j"], distinct=distinct).select("i", "j", "of", "form", "a", "b", "c", "d")


HOLDS = f"{far_sql('a', 'b')} = {far_sql('c', 'd')} and {far_sql('a', 'c')} = {far_sql('b', 'd')}"


# what balances in characters, and is as far apart along as across, is what the solver finds
@query(f"{CORE}, {QUAD} select a, b, c, d, case when {HOLDS} then d end solved from quad")
def solve_analogies(spark: SparkSession, d: str) -> DataFrame:
    q = analogies.of_clusters(ratios(spark, d), check=False)
    return q.select("a", "b", "c", "d", solve_analogy("a", "b", "c").alias("solved"))


@query(f"{CORE}, {QUAD} select a, b, c, d, {HOLDS} holds from quad")
def verify_analogies(spark: SparkSession, d: str) -> DataFrame:
    q = analogies.of_clusters(ratios(spark, d), check=False)
    return q.select("a", "b", "c", "d", verify_analogy("a", "b", "c", "d").alias("holds"))


# ---- grids -----------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grids.grids(filtered_clusters(spark, d), least=3)


@query()
def paradigm_grids(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query()
def saturated_grids(spark: SparkSession, d: str) -> DataFrame:
    return grids.grids(filtered_clusters(spark, d), saturation=0.8, least=3)


@query()
def grid_attributes(spark: SparkSession, d: str) -> DataFrame:
    return grids.attributes(_cells(spark, d))


@query()
def grid_statistics(spark: SparkSession, d: str) -> DataFrame:
    return grids.statistics(_cells(spark, d))


@query()
def grid_sink(spark: SparkSession, d: str) -> DataFrame:
    return text.grid_lines(_cells(spark, d))


@query()
def pretty_grids(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return text.pretty_grids(cells, grids.attributes(cells))


@query()
def predictable_words(spark: SparkSession, d: str) -> DataFrame:
    return grids.predictable_words(grids.grids(filtered_clusters(spark, d), least=3))


# ---- ordered rows, samples ---------------------------------------------------------------


@query("with r as (select event_id, event_type, user_id, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) g from events) select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) n from r group by user_id, event_type, g")
def run_blocks(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_blocks(table(spark, d, "events"), "event_type", "event_id", ["user_id"])


@query("select event_id, user_id, last_value(case when event_type = 'error' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) filled from events")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("value")).alias("filled"))
    return windows.forward_filled(events, "filled", "event_id", ["user_id"])


@query(f"{CORE} select cluster_id, a, b from raw qualify row_number() over (partition by cluster_id order by a, b) <= 2")
def first_n_ratios(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_n(ratios(spark, d).select("cluster_id", "a", "b"), ["cluster_id"], ["a", "b"], 2)


@query(f"with {top(50, None)} select lang, word, n from t")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d, 50, None)


@query(f"with {WORDS} select word from t order by md5(word || '|0'), word limit 100")
def random_sample_100(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample(all_words(spark, d), ["word"], 100)


@query(f"with {ALL} select lang, word from t qualify row_number() over (partition by lang order by md5(lang || '|' || word || '|0'), lang, word) <= 20")
def sample_each_language(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample_each(every_token(spark, d).select("lang", "word"), ["lang"], ["lang", "word"], 20)


@query(f"with {V}, s as (select w, row_number() over (order by w) - 1 r, count(*) over () c from v) select w word from range(10) t(k) join s on r = ('0x' || substr(md5(k || '|0'), 1, 8))::bigint % c")
def examples_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample_with_replacement(names(spark, d), "word", 10)


@query(f"with {WORDS} select word, case when ('0x' || substr(md5(word || '|42'), 1, 8))::bigint % 1000 < 700 then 'train' else 'test' end part from t")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return windows.split(all_words(spark, d), ["word"])


# ---- rules, languages, JSON ----------------------------------------------------------------


TREES = [
    ("one", '{"V": {"PST": {"1": "ed|d", "3": "t"}, "PRS": {"3": "s|es"}}, "N": {"PL": "s|es|en", "SG": "0"}}'),
    ("two", '{"V": {"PST": {"1": "d|te", "3": "te"}, "PRS": {"3": "t"}}, "N": {"PL": "en|er|s", "SG": "0"}, "A": "e"}'),
]
LEAVES = "leaves(lang, path, leaf) as (values ('one', ['V','PST','1'], 'ed|d'), ('one', ['V','PST','3'], 't'), ('one', ['V','PRS','3'], 's|es'), ('one', ['N','PL'], 's|es|en'), ('one', ['N','SG'], '0'), ('two', ['V','PST','1'], 'd|te'), ('two', ['V','PST','3'], 'te'), ('two', ['V','PRS','3'], 't'), ('two', ['N','PL'], 'en|er|s'), ('two', ['N','SG'], '0'), ('two', ['A'], 'e'))"


def _leaves(spark: SparkSession) -> DataFrame:
    return rules.leaves(spark.createDataFrame(TREES, "lang string, tree string"))


@query(f"with {LEAVES} select lang, array_to_string(path, '/') path, leaf from leaves")
def rule_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _leaves(spark).select("lang", F.array_join("path", "/").alias("path"), "leaf")


@query(f"with {LEAVES}, m as (select x.path, x.leaf, bool_or(coalesce((list_has_all(x.path, y.path) or list_has_all(y.path, x.path)) and list_has_any(string_split(x.leaf, '|'), string_split(y.leaf, '|')), false)) hit from leaves x, leaves y where x.lang = 'one' and y.lang = 'two' group by x.path, x.leaf) select count(*) filter (hit) marked, count(*) total, round(100.0 * count(*) filter (hit) / count(*))::bigint percent from m")
def rule_similarity(spark: SparkSession, d: str) -> DataFrame:
    found = _leaves(spark)
    return rules.similarity(found.where("lang = 'one'"), found.where("lang = 'two'"))


@query("select '{' || string_agg('\"' || p_brand || '\":' || n, ',' order by p_brand) || '}' as value from (select p_brand, count(*) n from part group by p_brand)")
def json_map(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return text.to_json_map(counted, "p_brand", "n")


@query(f"with {MSD} select kind, n, case when kind = 'words' then 'plain' when kind = 'fields' then 'sig2017' else 'sig2016' end sniffed from (select unnest(['words', 'fields', 'attributes']) kind), (select count(*) n from m)")
def sniffed_formats(spark: SparkSession, d: str) -> DataFrame:
    """What the lines of each kind of file are taken for."""
    rows = tagged(spark, d)
    kinds = {"words": F.col("form"), "fields": F.concat_ws("\t", "lemma", "form", "msd"), "attributes": F.concat_ws("\t", "lemma", F.concat(F.lit("type="), "lemma", F.lit(",brand="), "brand"), "form")}
    out = None
    for kind, line in kinds.items():
        lines = rows.select(line.alias("value"))
        one = lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(text.sniff_sigmorphon(lines)).alias("sniffed"))
        out = one if out is None else out.union(one)
    return out


@query("select (props::json ->> 'k')::bigint k, count(*) n from events group by 1")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


LANGS = (
    f"{ALL}, al as (select lang, list(distinct c) alphabet from (select lang, unnest(string_split(word, '')) c from t) group by lang), "
    "g as (select y.lang, x.word a, y.word b, right(y.word, 1) x from t x join t y on x.lang = y.lang and x.word = left(y.word, length(y.word) - 1)), "
    "n as (select * from (select lang, a, b, lead(a) over w c, lead(b) over w d from g window w as (partition by lang, x, left(a, 2) order by a)) where c is not null), "
    "o as (select lang, word, lead(word) over (partition by lang, list_sort(string_split(word, '')) order by word) other from t), "
    "q as (select lang, a, b, c, d, true valid from n union all select lang, b, a, c, d, false from n union all select n.lang, a, b, c, other, false from n join o on n.lang = o.lang and n.d = o.word where other is not null)"
)
MEANS = "round(avg(((p > 0.5) = valid)::int) filter (valid), 6) acc_valid, round(avg(((p > 0.5) = valid)::int) filter (not valid), 6) acc_invalid, round(avg(((p > 0.5) = valid)::int), 6) acc_raw"


def _scored(known: str) -> str:
    """The matrix of the rule scorer, where the letters that a model knows are those of its language or of the data's."""
    return f"{LANGS}, s as (select m.lang model_lang, q.lang data_lang, valid, case when {SORTED.format('a', 'd')} = {SORTED.format('b', 'c')} then case when list_has_all({known}, string_split(a || b || c || d, '')) then 0.9 else 0.4 end else 0.1 end p from q join al own using (lang), al m), mx as (select model_lang, data_lang, {MEANS} from s group by model_lang, data_lang)"


SCORED = _scored("m.alphabet")


def _alphabets(t: DataFrame) -> DataFrame:
    return t.select("lang", F.explode(S.chars("word")).alias("ch")).groupBy("lang").agg(F.collect_set("ch").alias("alphabet"))


def _quads(t: DataFrame) -> DataFrame:
    """Analogies of real words: of two words and what they are with one more
    letter, next to each other among the words that begin alike.  Of each, two
    that do not hold: one turned round, and where the last word has the letters of
    another one, with that, so that characters balance all the same."""
    one, more = t.select("lang", F.col("word").alias("a")), t.select("lang", F.col("word").alias("b"), F.expr("left(word, length(word) - 1)").alias("a"), F.expr("right(word, 1)").alias("x"))
    grown = one.join(more, ["lang", "a"])
    begin = Window.partitionBy("lang", "x", F.substring("a", 1, 2)).orderBy("a")
    good = grown.select("lang", "a", "b", F.lead("a").over(begin).alias("c"), F.lead("b").over(begin).alias("d")).where("c is not null")
    alike = Window.partitionBy("lang", S.alphagram("word")).orderBy("word")
    other = t.select("lang", F.col("word").alias("d"), F.lead("word").over(alike).alias("other")).where("other is not null")
    quad = lambda a, b, c, d, valid: F.struct(*[F.col(x).alias(y) for x, y in zip((a, b, c, d), "abcd", strict=True)], F.lit(valid).alias("valid"))
    swapped = F.when(F.col("other").isNotNull(), quad("a", "b", "c", "other", False))
    made = F.array_compact(F.array(quad("a", "b", "c", "d", True), quad("b", "a", "c", "d", False), swapped))
    return good.join(other, ["lang", "d"], "left").select("lang", F.explode(made).alias("q")).select("lang", "q.*")


def _spoken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The languages' alphabets, and the analogies of their words; documents are read once."""
    t = kept(every_token(spark, d).select("lang", "word"))
    return _alphabets(t), _quads(t)


def _matrix(spark: SparkSession, d: str, mode: str = "full") -> DataFrame:
    alphabets, quads = _spoken(spark, d)
    return transfer.matrix(alphabets, kept(transfer.looked_at(quads)), mode=mode)


@query(f"with {SCORED} select * from mx")
def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(f"with {SCORED} select model_lang, max(acc_valid) filter (data_lang = 'de') de, max(acc_valid) filter (data_lang = 'en') en, max(acc_valid) filter (data_lang = 'es') es, max(acc_valid) filter (data_lang = 'fr') fr from mx group by model_lang")
def transfer_pivot(spark: SparkSession, d: str) -> DataFrame:
    return transfer.pivoted(_matrix(spark, d), ["de", "en", "es", "fr"], "acc_valid")


@query(f"with {SCORED} select least(model_lang, data_lang) l1, greatest(model_lang, data_lang) l2, round(avg(acc_invalid), 6) weight from mx where model_lang <> data_lang group by 1, 2")
def language_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return transfer.adjacency(_matrix(spark, d))


@query()
def dendrogram(spark: SparkSession, d: str) -> DataFrame:
    return transfer.dendrogram(transfer.adjacency(_matrix(spark, d), "acc_valid"))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return transfer.communities(transfer.adjacency(_matrix(spark, d), "acc_valid"))


@query(f"with {SCORED} select model_lang, data_lang, acc_valid, acc_invalid, acc_raw from mx")
def transfer_table(spark: SparkSession, d: str) -> DataFrame:
    """The matrix as a wide table of tuples, and read from that again."""
    return text.matrix(text.matrix_table(_matrix(spark, d)))


@query(f"with {SCORED} select * from mx where model_lang = 'de' and data_lang = 'fr'")
def transfer_cell(spark: SparkSession, d: str) -> DataFrame:
    return transfer.look_up(_matrix(spark, d), "de", "fr")


@query()
def learned_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A logistic regression for each language, judged on all languages' analogies."""
    alphabets, quads = _spoken(spark, d)
    quads = kept(transfer.measured(quads))
    weights = transfer.weights(spark, transfer.train(quads))
    return transfer.matrix(alphabets.join(weights, "lang"), quads, transfer.learned)


@query(f"with {_scored('own.alphabet')} select * from mx")
def partial_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, mode="partial")


def _trained(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Networks of all languages, trained on seven tenths of their quads, judged on the rest."""
    quads = kept(windows.split(_spoken(spark, d)[1], ["lang", "a", "b", "c", "d"]))
    trained = neural.train(quads.where("part = 'train'"))
    return neural.matrix(trained, quads.where("part = 'test'"), mode)


@query()
def trained_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "full")


@query()
def trained_partial_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, "partial")


CHANGED = "(values ('two', ['V','PST','3'], 'tet'), ('one', ['X'], 'y'))"


@query(f"with {LEAVES}, ch(lang, path, leaf) as (select * from {CHANGED}) select l.lang, array_to_string(l.path, '/') path, array_to_string(l.path, ' > ') || ' = ' || coalesce(ch.leaf, l.leaf) value from leaves l left join ch on l.lang = ch.lang and l.path = ch.path")
def changed_rules(spark: SparkSession, d: str) -> DataFrame:
    changes = spark.createDataFrame([("two", ["V", "PST", "3"], "tet"), ("one", ["X"], "y")], "lang string, path array<string>, leaf string")
    return rules.rendered(rules.assigned(_leaves(spark), changes))


# ---- files read and written -----------------------------------------------------------------


EQUAL = "string_agg(w, ' == ' order by w)"


def word_file(spark: SparkSession, d: str, ordered: bool = False) -> DataFrame:
    """(value): the vector file of all words."""
    words = kept(all_words(spark, d))  # for letters and classes alike
    return text.class_file(features.anagram_vectors(words), ordered)


@query(f"with {ACORE}, g as (select x, min(w) w, count(*) n, {EQUAL} m from vec group by x) select '# ' || m as value from g where n > 1 union all select w || chr(9) || '(' || array_to_string(x, ', ') || ')' from g")
def vector_file(spark: SparkSession, d: str) -> DataFrame:
    return word_file(spark, d, ordered=True)


@query(f"with {ACORE}, g as (select x, min(w) w from vec group by x) select w word, array_to_string(x, ',') v from g")
def vector_file_source(spark: SparkSession, d: str) -> DataFrame:
    back = text.vectors(word_file(spark, d))
    return back.select("word", F.array_join("v", ",").alias("v"))


@query(f"with {ACORE}, g as (select min(w) rep, count(*) n, string_agg(w, ' ' order by w) members from vec group by x) select rep, members from g where n > 1")
def equivalents_source(spark: SparkSession, d: str) -> DataFrame:
    back = text.equivalents(word_file(spark, d))
    return back.select("rep", F.array_join("members", " ").alias("members"))


@query(f"{CORE} select cluster_id, size, a, b from raw")
def clusters_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the vectors that a file holds."""
    lines = text.vector_file(features.char_vectors(names(spark, d)))
    return clusters.raw_clusters(text.vectors(lines))


MARKS = f"dup as (select cluster_id, count(distinct a) = count(*) and count(distinct b) = count(*) and bool_and(a <> b) \"unique\" from raw group by cluster_id), agr as (select x.cluster_id, bool_and({AGREE}) agree from {TWO} group by x.cluster_id), mark as (select cluster_id, case when \"unique\" then '' when agree then 'OOO ' else 'XXX ' end mark from dup join agr using (cluster_id))"


@query(f"{CORE}, {MARKS} select size, cluster_id, size || chr(9) || mark || string_agg(a || ' : ' || b, ' :: ' order by a, b) as value from raw join mark using (cluster_id) group by size, cluster_id, mark")
def marked_cluster_sink(spark: SparkSession, d: str) -> DataFrame:
    r = ratios(spark, d).select("cluster_id", "a", "b")
    rows = windows.numbered(r, ["cluster_id"], ["a", "b"], "pos")
    return text.cluster_lines(rows, marks=clusters.marked(r), sizes=True).select(F.col("size").cast("long").alias("size"), "cluster_id", "value")


@query(f"{CORE}, s as (select string_agg(a || ' : ' || b, ' :: ' order by a, b) line, list((a, b)) r from raw group by cluster_id), u as (select line cluster_id, unnest(r) r from s) select cluster_id, r[1] a, r[2] b from u")
def cluster_file(spark: SparkSession, d: str) -> DataFrame:
    """A file with the equivalents' header, sizes and marks, read again."""
    r = ratios(spark, d).select("cluster_id", "a", "b")
    head = text.equivalent_lines(features.equivalence_classes(features.char_vectors(names(spark, d))))
    rows = windows.numbered(r, ["cluster_id"], ["a", "b"], "pos")
    lines = text.concatenated(head, text.cluster_lines(rows, marks=clusters.marked(r), sizes=True).select("value"))
    return text.cluster_file(lines)[1].select("cluster_id", "a", "b")


@query(f"{CORE}, every as (select distinct x.a, x.b, y.a c, y.b d from {TWO}) select a, b, c, d from every where not ((a = b and c = d) or (a = c and b = d)) and {SORTED.format('a', 'd')} = {SORTED.format('b', 'c')} and {far_sql('a', 'b')} = {far_sql('c', 'd')} and {far_sql('a', 'c')} = {far_sql('b', 'd')}")
def analogy_source(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all pairs of a cluster's ratios, read again without the invalid and trivial ones."""
    x, y = ratios(spark, d).alias("x"), ratios(spark, d).alias("y")
    pairs = x.join(y, (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.struct("x.a", "x.b") < F.struct("y.a", "y.b")))
    lines = pairs.select(F.concat("x.a", F.lit(" : "), "x.b", F.lit(" :: "), "y.a", F.lit(" : "), "y.b").alias("value"))
    return text.analogies(lines)


@query("select p_type lemma, p_name form, p_brand || ';' || p_size msd, 2 n from part")
def triples_source(spark: SparkSession, d: str) -> DataFrame:
    """Lines of lemma, form and features, and some that are none, read again."""
    part = table(spark, d, "part")
    lines = part.select(F.concat_ws("\t", "p_type", "p_name", F.concat_ws(";", "p_brand", F.col("p_size").cast("string"))).alias("value"))
    bad = part.select(F.concat_ws("\t", "p_type", "p_name").alias("value"))
    return text.sigmorphon(text.concatenated(lines, bad)).select("lemma", "form", "msd", F.size("feats").alias("n"))


@query("select p_type lemma, p_brand msd from part")
def blind_source(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lines = text.concatenated(part.select(F.concat_ws("\t", "p_type", "p_brand").alias("value")), part.select(F.col("p_name").alias("value")))
    return text.blind(lines)


@query(f"with {V} select w word from v union all select distinct p_type from part")
def shuffled_words(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "part").select(F.col("p_type").alias("word")).distinct()
    return text.shuffled(text.concatenated(names(spark, d), other))


MARKDOWN = ["| Family | Language | Code |", "|---|---|---|", "| Indo-European | English | eng |", "| | German | deu |", "| Uralic | Finnish | fin |", "| | Hungarian | hun |"]


@query("select * from (values ('eng', 'germanic', 'English'), ('deu', 'germanic', 'German'), ('fin', 'uralic', 'Finnish'), ('hun', 'uralic', 'Hungarian')) t(code, family, name)")
def language_table(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(MARKDOWN, 1)), "line_no int, value string")
    return text.markdown_languages(lines)


# ---- more about clusters ------------------------------------------------------------------------


@query(f"{CORE}, {MARKS} select cluster_id, \"unique\" from dup")
def no_duplicate_words(spark: SparkSession, d: str) -> DataFrame:
    return clusters.no_duplicate_words(ratios(spark, d))


@query(f"{CORE}, f as (select min(w) w from rep) select distinct cluster_id from raw, f where a = w or b = w")
def clusters_with_word(spark: SparkSession, d: str) -> DataFrame:
    return clusters.look_up(ratios(spark, d), names(spark, d).agg(F.min("word")).first()[0])


MEET = "w as (select distinct cluster_id, unnest([a, b]) w from raw), meet as (select distinct x.cluster_id, y.cluster_id other_id from w x join w y using (w))"


@query(f"{CORE}, {MEET} select * from meet")
def meeting_clusters(spark: SparkSession, d: str) -> DataFrame:
    r = ratios(spark, d)
    return clusters.meeting(r, r)


@query(f"{CORE}, {MEET}, k as (select distinct cluster_id, size from raw) select x.cluster_id, y.cluster_id other_id from k x join k y using (size) anti join meet on meet.cluster_id = x.cluster_id and meet.other_id = y.cluster_id")
def empty_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs of clusters of the same size."""
    r = ratios(spark, d)
    ids = r.select("cluster_id", "size").distinct()
    pairs = ids.join(ids.withColumnRenamed("cluster_id", "other_id"), "size").select("cluster_id", "other_id")
    return clusters.empty_intersections(pairs, r, r)


def _same(x: str, y: str) -> str:
    return f"(length({x}) + length({y}) - 2 * {far_sql(x, y)})"


GAMMA = [f"{_same(x, y)} + {_same(x, z)} - length({x})" for x, y, z in (("a", "b", "c"), ("b", "a", "d"), ("c", "a", "d"), ("d", "b", "c"))]


@query(f"{CORE}, two as (select x.cluster_id, x.a, x.b, y.a c, y.b d from {TWO} where x.size = 2), good as (select cluster_id from two where {GAMMA[0]} = {GAMMA[1]} and {GAMMA[1]} = {GAMMA[2]} and {GAMMA[2]} = {GAMMA[3]}) select cluster_id, a, b from raw where size > 2 or cluster_id in (from good)")
def gamma_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.gamma_hypothesis(ratios(spark, d).drop("size"))


@query(f"{CORE}, {MARKS}, c as (select count(*) size from vec group by x), k as (select count(*) size from raw group by cluster_id) select 'class' what, size, count(*) n from c group by size union all select 'cluster', size, count(*) from k group by size union all select 'duplicate words', null, count(*) filter (not \"unique\") from dup union all select 'distances differ', null, count(*) filter (not agree) from agr")
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    return clusters.report(ratios(spark, d), features.equivalence_classes(features.char_vectors(names(spark, d))))


@query(f"{CORE} select (count(*) * (count(*) - 1) / 2)::bigint pairs from rep")
def surface(spark: SparkSession, d: str) -> DataFrame:
    return clusters.surface(features.representatives(features.char_vectors(names(spark, d))))


THROWN = "edge as (select x.n_nationkey a, y.n_nationkey b from nation x join nation y on x.n_nationkey < y.n_nationkey where ('0x' || substr(md5(x.n_nationkey || '|' || y.n_nationkey || '|0'), 1, 8))::bigint % 1000 < 400)"


def _relation(spark: SparkSession, d: str) -> DataFrame:
    return clusters.random_edges(table(spark, d, "nation").select(F.col("n_nationkey").alias("v")), 0.4)


@query(f"with {THROWN} select a, b from edge")
def random_relation(spark: SparkSession, d: str) -> DataFrame:
    return _relation(spark, d)


@query(
    f"with recursive {THROWN}, near as (select a, b from edge union all select b, a from edge), "
    "grown(m) as (select [n_nationkey] from nation union all select list_append(m, b) from grown join edge on edge.a = m[len(m)] where (select count(*) from near where near.b = edge.b and list_contains(m, near.a)) = len(m)) "
    "select array_to_string(m, ',') members, len(m) size from grown where not exists (select 1 from near where list_contains(m, near.a) group by near.b having count(*) = len(m))"
)
def maximal_cliques(spark: SparkSession, d: str) -> DataFrame:
    vertices = table(spark, d, "nation").select(F.col("n_nationkey").alias("v"))
    found = cliques.maximal_cliques(_relation(spark, d), vertices)
    return found.select(F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"), F.size("members").cast("long").alias("size"))


@query()
def consistent_cliques(spark: SparkSession, d: str) -> DataFrame:
    """All maximal sets of consistent ratios of the clusters of the part names."""
    found = cliques.consistent_cliques(clusters.horizontal_split(ratios(spark, d)))
    said = F.array_join(F.transform("members", lambda r: F.concat_ws(" : ", r["a"], r["b"])), " :: ")
    return found.select("cluster_id", "d", said.alias("members"))


@query(f"with {THROWN} select b v from edge where a = 7 union select a from edge where b = 7")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return clusters.neighbours(_relation(spark, d), 7)


@query(f"with {PQUAD}, e as (select i, j, a, c b, b c, d from q), o as (select * from e where not (a = b or c = d)) {_orders(analogies.NEGATIVE, 'o')}")
def negatives_of_one_form(spark: SparkSession, d: str) -> DataFrame:
    return analogies.balanced_negatives(quads(spark, d), ["i", "j"], all_forms=False)


@query()
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    return analogies.success(analogies.random_equations(spark, 1000))


@query()
def grid_averages(spark: SparkSession, d: str) -> DataFrame:
    return grids.averages(_cells(spark, d))


@query()
def grid_statistics_sink(spark: SparkSession, d: str) -> DataFrame:
    return text.statistics_lines(grids.statistics(_cells(spark, d)))


@query()
def grid_source(spark: SparkSession, d: str) -> DataFrame:
    return text.grids(text.grid_lines(_cells(spark, d)).select("value"))


# ---- grids of given cells ----------------------------------------------------------------------


CELL = "cell as (select p_brand grid_id, (p_size % 7)::int as \"row\", (length(p_name) % 5)::int col, min(p_name) word from part group by 1, 2, 3)"
SHAPE = f"{CELL}, shape as (select grid_id, max(\"row\") + 1 length, max(col) + 1 width, count(*) filled from cell group by grid_id), attr as (select grid_id, length, width, length * width size, filled, round(filled / (length * width), 6) saturation from shape)"
FULL = f"{SHAPE}, full_ as (select grid_id, r.i::int as \"row\", c.i::int col from shape, range(7) r(i), range(5) c(i) where r.i < length and c.i < width), named as (select grid_id, \"row\", col, coalesce(word, 'None') word from full_ left join cell using (grid_id, \"row\", col))"


def _part_cells(spark: SparkSession, d: str) -> DataFrame:
    """Part names as cells of one grid a brand."""
    cell = table(spark, d, "part").groupBy(F.col("p_brand").alias("grid_id"), (F.col("p_size") % 7).cast("int").alias("row"), (F.length("p_name") % 5).cast("int").alias("col"))
    return cell.agg(F.min("p_name").alias("word"))


@query(f"with {SHAPE} select * from attr")
def part_grid_attributes(spark: SparkSession, d: str) -> DataFrame:
    return grids.attributes(_part_cells(spark, d))


@query(f"with {SHAPE} select size, saturation, count(*) freq from attr group by all")
def part_grid_statistics(spark: SparkSession, d: str) -> DataFrame:
    return grids.statistics(_part_cells(spark, d))


@query(f"with {SHAPE} select count(*) grids, round(avg(size), 6) size, round(avg(saturation), 6) saturation from attr")
def part_grid_averages(spark: SparkSession, d: str) -> DataFrame:
    return grids.averages(_part_cells(spark, d))


@query(f"with {SHAPE} select size || chr(9) || saturation || chr(9) || count(*) as value from attr group by size, saturation")
def part_grid_statistics_sink(spark: SparkSession, d: str) -> DataFrame:
    return text.statistics_lines(grids.statistics(_part_cells(spark, d)))


LINES = f"{FULL}, l as (select grid_id, \"row\", string_agg(word, ' : ' order by col) line from named group by all)"


@query(f"with {LINES} select grid_id, string_agg(line, ' :: ' order by \"row\") as value from l group by grid_id")
def part_grid_sink(spark: SparkSession, d: str) -> DataFrame:
    return text.grid_lines(_part_cells(spark, d))


@query(f"with {LINES}, g as (select grid_id, string_agg(line, ' :: ' order by \"row\") id from l group by grid_id) select id grid_id, \"row\", col, word from cell join g using (grid_id)")
def part_grid_source(spark: SparkSession, d: str) -> DataFrame:
    return text.grids(text.grid_lines(_part_cells(spark, d)).select("value"))


@query(f"with {FULL}, wide as (select grid_id, max(length(word)) w from named group by grid_id) select grid_id, \"row\", string_agg(rpad(case when word = 'None' then '' else word end, w::int, ' '), ' : ' order by col) as value from named join wide using (grid_id) group by all")
def part_pretty_grids(spark: SparkSession, d: str) -> DataFrame:
    return text.pretty_grids(_part_cells(spark, d))


@query(f"with {top(400)}, v as (select word w from t), {ALPHA}, {VEC}, {REP}, {PAIR}, {RAW}, class as (select min(w) over (partition by x) rep, w from vec) select cluster_id, p.w a, q.w b from raw join class p on p.rep = a join class q on q.rep = b")
def expanded_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the representatives of 400 tokens, with all their equivalents."""
    v = features.char_vectors(tokens(spark, d, 400))
    return clusters.expanded(clusters.raw_clusters(features.representatives(v)), features.equivalence_classes(v))


@query(f"{CORE.replace('with', 'with recursive', 1)}, member as (select distinct cluster_id c, unnest([a, b]) w from raw where size between 2 and 8), meet as (select distinct x.c, y.c other from member x join member y using (w)), reach(c, other) as (select c, other from meet union select reach.c, meet.other from reach join meet on reach.other = meet.c) select c cluster_id, min(other) component from reach group by c")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    return grids.components(ratios(spark, d).where("size between 2 and 8").select("cluster_id", "a", "b"))
