"""The registered queries of the subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.judged(docs, model).drop("text")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm import langid

    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.identified(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.bpe import encoded

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encoded(docs, *rank_file(), ids=False, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm import warc
    from curatorium.sources.sinks import shared_folder

    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.captures(warc.read(spark, folder), payload=False)
    return found.select(
        F.col("metadata.page_id").try_cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), F.col("refers_to.page_id").try_cast("long").alias("refers_to"))


def op6_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.voronoi import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.lines import without_boilerplate

    found = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"),
                        F.sha2(F.col("text"), 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.mixing import mixed

    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.urls import judged

    return judged(table(spark, sf_dir, "pages")).drop("url")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.minhash import with_classes

    found = with_classes(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes of the fingerprints of op9: bands joined, likeness verified."""
    from curatorium.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sigtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatorium.llm.sigtree import near_sets

    return near_sets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_langid, op4_bpe, op5_warc, op6_voronoi, op7_lines, op8_mixing, op9_minhash, op10_urls, op11_phrases, op12_maxscore, op13_sigtree, minhash_groups)}
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

CHECKS = {
    "op5_warc": """
with d as (
    select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x, strlen(coalesce(html, '')) as n from pages),
f as (select *, min(page_id) over (partition by x, n) as first from d)
select page_id, n as payload_bytes,
    (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) & 31), 1), '' order by i) from range(32) r(i)) as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id <> first then first end as refers_to
from f""",
    "op6_voronoi": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
    where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op7_lines": r"""
with l as (
    select doc_id, source, i, ls[i] as line, trim(ls[i], ' ') as t
    from (select doc_id, source, string_split(text, chr(10)) as ls from documents) d, unnest(range(1, len(ls) + 1)) u(i)),
bad as (
    select t from l where t <> '' group by t having count(distinct coalesce('s' || source, 'none')) >=
        case when len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) > 50 then 5 else 8 end),
twin as (select text, count(distinct coalesce('k' || doc_id, 'none')) > 1 as copy from documents group by text),
k as (
    select doc_id, string_agg(line, chr(10) order by i) filter (where bad.t is null) as rest, count(bad.t) as n
    from l left join bad using (t) group by doc_id),
c as (
    select d.doc_id, d.text, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(k.rest, '') as rest,
        coalesce(k.n, 0) > 0 and not twin.copy and regexp_matches(coalesce(k.rest, ''), '[^ \n]') as cut, k.n
    from documents d left join k using (doc_id) left join twin on twin.text = d.text)
select doc_id, n_lines::int as n_lines, (case when cut then n else 0 end)::int as n_removed,
    length(case when cut then rest else text end) as n_chars_kept, sha256(case when cut then rest else text end) as text_sha256
from c""",
    "op8_mixing": f"""
with d as (select doc_id, source, {_WORDS} as size from documents),
s as (
    select source, sum(size)::bigint as source_size,
        [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from d group by source),
o as (select *, 3.0::double * source_size / weight as full_at from s),
p as (
    select *, coalesce(sum(3 * source_size) over w, 0) as before, sum(weight) over (order by full_at desc, source desc
        rows between unbounded preceding and current row) as rest, sum(source_size) over () as total
    from o window w as (order by full_at, source rows between unbounded preceding and 1 preceding)),
level as (select arg_min((total - before)::double / rest, before) as share from p where (total - before)::double / rest < full_at),
t as (
    select source, source_size, case when weight * share >= 3 * source_size then (3 * source_size)::double else weight * share end as target
    from s, level),
q as (
    select d.*, t.source_size, t.target, md5('0|' || coalesce(doc_id::varchar, '')) as deal, sum(size) over (
        partition by d.source order by md5('0|' || coalesce(doc_id::varchar, '')), doc_id rows unbounded preceding) as upto
    from d join t on d.source is not distinct from t.source),
c as (select *, (2 * upto - size + 2 * k * source_size)::double / (2 * target) as finish from q, range(3) r(k) where size > 0),
m as (select *, sum(size) over (order by finish, source nulls last, deal, doc_id rows unbounded preceding) as upto_all from c)
select q.doc_id, q.size, q.source_size, q.target, q.size * count(m.k) as taken
from q left join m on m.doc_id = q.doc_id and m.upto_all <= (select sum(size) from d)
group by q.doc_id, q.size, q.source_size, q.target""",
    "op11_phrases": r"""
with t as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from t),
g as (
    select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f
    from p, unnest(range(1, 6)) a(k), unnest(range(1, len(w) - k + 2)) b(i) group by all),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from g where k >= 2 and f >= 100),
inner_ as (
    select lang, array_to_string(w[i:i + j - 1], ' ') as phrase, max(f) as most
    from c, unnest(range(2, k)) a(j), unnest(range(1, k - j + 2)) b(i) group by all),
s as (
    select c.lang, c.phrase, c.f as a, x.f as l, y.f as r, n.n, j,
        ((1000::hugeint * c.f * n.n) // (x.f::hugeint * y.f))::bigint as score
    from c join n using (lang), unnest(range(1, k)) u(j)
        join g x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
        join g y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:], ' ')
    where not exists (from inner_ i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.most >= 100 * c.f)),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from m qualify rank <= 2000""",
    "op12_maxscore": r"""
with t as (
    select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select row, doc_id, w, len(w) as n from t where len(w) > 0),
c as (select count(*) as docs, sum(n)::bigint as terms from d),
p as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(w) as term from d) group by all),
f as (select term, count(*) as df from p group by term),
i as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
x as (
    select row, doc_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint
        * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) as impact
    from p join f using (term), c),
s as (select item_id, row, doc_id, sum(impact)::bigint as score from i join x using (term) group by item_id, row, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50""",
    "op13_sigtree": r"""
with recursive t as (
    select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (
    select row, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else
        list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as g from t),
e as (select doc_id, row, len(g)::bigint as n, unnest(g) as g from s),
b as (
    select x.row as a, y.row as b from e x join e y on x.g = y.g and x.row < y.row and 100 * x.n >= 90 * y.n and 100 * y.n >= 90 * x.n
    group by x.row, y.row, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r(row, seen) as (
    select row, row from s
    union select n.b, r.seen from r join (select a, b from b union all select b, a from b) n on n.a = r.row)
select s.doc_id, len(s.g)::bigint as n_shingles, min(o.doc_id) as component_id
from s join r on r.row = s.row join s o on o.row = r.seen group by s.row, s.doc_id, len(s.g)""",
    # no page of the given tables names a canonical address or a refresh, so no component has more than one address
    "op10_urls": """
with u as (
    select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
p as (
    select page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
rules(h, b, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
    select page_id, arg_max(h || b, length(h || b)) as rule, arg_max(v, length(h || b)) as verdict
    from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, b) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (page_id)""",
}
