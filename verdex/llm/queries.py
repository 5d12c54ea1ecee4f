"""Thin queries over whole tables; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import bpe, collocations, convtrie, decontam, embeddedup, exactdedup, htmlextract, langid, minhash, quality, tokencount, toxicity, urlfilter
from verdex.llm.common import Scratch, fold, if_small, table


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, modulus: int, held: int) -> DataFrame:
    """Texts with labels outside the held-out fold; one label for each doc_id."""
    marks = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & (fold("doc_id", modulus) != held))
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.where(fold("doc_id", modulus) != held).select("doc_id", "text").join(if_small(marks), "doc_id")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 5) != 0), "text", "lang", "doc_id")
    held = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return langid.predict(held, model, keep=["doc_id", "held_out"])


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = tokencount.redaction_edits(tokencount.build(docs)).withColumn("n_tokens_before", F.col("n_tokens"))
    counted = tokencount.update(trees, keep=["doc_id", "n_tokens_before", "edits", "n_tokens", "n_chars_reencoded"])
    return counted.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.size("edits").cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), "n_chars_reencoded")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(labelled(spark, docs, sf_dir, "quality", 4, 2), "text", "label", "doc_id")
    held = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return quality.score(held, model, keep=["doc_id", "held_out"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, keep=["doc_id"], decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmlextract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, keep=["page_id"]).drop("pattern")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(labelled(spark, docs, sf_dir, "toxic", 3, 1), "text", "label", "doc_id")
    held = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return toxicity.score(held, model, keep=["doc_id", "held_out"]).drop("passages")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language, a report."""
    found = collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))
    return collocations.first_of_each(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        turns, convs = convtrie.shared_openings(convtrie.ordered(table(spark, sf_dir, "conversations")), group=100, modulus=6)
        trie = convtrie.prefix_trie(turns, convs)
        hashed = convtrie.list_hashes(trie.ends)
        nodes = trie.nodes.join(hashed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
        return scratch.keep(nodes, "nodes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_html_extract": op8_html_extract,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Site rules as (rule, verdict), longest first, for the oracle.
_RULES = sorted(((r.name, r.verdict) for r in urlfilter.SITE_RULES), key=lambda r: (-len(r[0]), r[0]))


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash + path}')"


_OP9 = f"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), ruled as (
  select page_id, host, path, case {" ".join(f"when {_fits(r)} then '{r}'" for r, _ in _RULES)} end as rule from split
)
select page_id, host, path, rule,
  case {" ".join(f"when rule = '{r}' then '{v}'" for r, v in _RULES)}
    when regexp_matches(host, '(^|[.-])({"|".join(urlfilter.BLOCKED_WORDS)})([.:-]|$)') then 'block' else 'allow' end as verdict
from ruled
"""

#: The smallest id reachable over links (a, b), which has both directions and is named ``links``.
_REACH = """
reach(id, other) as (
  select id, id from nodes union select reach.id, links.b from reach join links on links.a = reach.other
), components as (select id, min(other) as component_id from reach group by id)
"""

_OP6 = f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') as ws from documents
), sets as (
  select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as shingles from words
), each as (select doc_id, unnest(shingles) as shingle from sets),
common as (select l.doc_id as a, r.doc_id as b, count(*) as n from each l join each r on l.shingle = r.shingle and l.doc_id <> r.doc_id group by 1, 2),
links as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.shingles) + len(y.shingles) - n)),
nodes as (select doc_id as id from documents), {_REACH}
select doc_id, cast(len(shingles) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join components on id = doc_id
"""

_OP2 = f"""
with recursive vectors as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.95),
nodes as (select vec_id as id from embeddings), {_REACH},
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join components on id = vec_id left join counts on a = vec_id
"""

#: All windows that hold a shingle of an item, and the best of each document and item.
_OP7 = r"""
with doc_words as (select row_number() over () as row_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from documents),
item_words as (select row_number() over () as row_id, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from benchmark),
items as (select row_id as item_row, item_id, len(ws) as size, least(5, len(ws)) as k, list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ')) as shingles from item_words where len(ws) > 0),
docs as (select row_id as doc_row, doc_id, len(ws) as n, k, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')) as shingles from doc_words, (select distinct k from items) where len(ws) >= k),
doc_at as (select doc_row, k, unnest(shingles) as shingle, generate_subscripts(shingles, 1) - 1 as pos from docs),
bags as (select item_row, shingle, count(*) as c from (select item_row, unnest(shingles) as shingle from items) group by 1, 2),
hits as (select distinct doc_row, i.item_row, pos from doc_at d join bags b using (shingle) join items i on i.item_row = b.item_row and i.k = d.k),
spans as (select h.doc_row, h.item_row, h.pos, d.n, i.size, least(i.size, d.n) as width, least(i.size, d.n) - i.k + 1 as span, i.k from hits h join items i using (item_row) join docs d on d.doc_row = h.doc_row and d.k = i.k),
starts as (select distinct doc_row, item_row, width, span, k, unnest(range(greatest(pos - span + 1, 0), least(pos, n - width) + 1)) as first_word from spans),
counted as (select s.doc_row, s.item_row, s.width, s.span, s.k, s.first_word, b.c as wanted, count(*) as c
  from starts s join doc_at d on d.doc_row = s.doc_row and d.k = s.k and d.pos between s.first_word and s.first_word + s.span - 1 join bags b on b.item_row = s.item_row and b.shingle = d.shingle group by s.doc_row, s.item_row, s.width, s.span, s.k, s.first_word, b.shingle, b.c),
met as (select doc_row, item_row, width, span, first_word, sum(least(wanted, c)) as both_ from counted group by all),
scored as (select m.*, both_ / (m.span + len(i.shingles) - both_) as similarity from met m join items i using (item_row)),
best as (select *, row_number() over (partition by doc_row, item_row order by similarity desc, first_word) as rn from scored where 100 * similarity >= 80 - 1e-9)
select doc_id, item_id, similarity, cast(first_word as bigint) as first_word, cast(width as bigint) as n_words from best join (select distinct doc_row, doc_id from docs) using (doc_row) join items using (item_row) where rn = 1
"""

#: The text of pages that have one article, without parts to leave out in it, as all pages of the table have.
_OP8 = r"""
with inside as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as a from pages),
lines as (select page_id, url, string_split(regexp_replace(regexp_replace(a, '</?(h[1-6]|p|br|ul|ol|li|div|section|blockquote)[^>]*>', chr(10) || chr(1), 'g'), '<[^>]*>', '', 'g'), chr(10) || chr(1)) as ls from inside),
decoded as (select page_id, url, list_transform(ls, lambda l: regexp_replace(replace(replace(replace(replace(l, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g')) as ls from lines),
texts as (select page_id, url, array_to_string(list_filter(list_transform(ls, lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) as text from decoded)
select page_id, url, text, cast(length(text) as bigint) as n_chars from texts
"""

_OP11 = r"""
with texts as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
groups as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from texts group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from texts join groups using (text_sha256)
"""

_OP12 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
  from documents
), grams as (
  select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m))
), counts as (select lang, m, phrase, count(*) as f from grams group by all
), totals as (select lang, cast(sum(f) as bigint) as n from counts where m = 1 group by 1
), phrases as (select lang, phrase, m, f as a, string_split(phrase, ' ') as ws from counts where m > 1 and f >= 30
), cuts as (
  select p.*, k, x.f as l, y.f as r, cast((2000000::hugeint * a) // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, m)) as k from phrases) p
  join counts x on x.lang = p.lang and x.m = k and x.phrase = array_to_string(ws[1:k], ' ')
  join counts y on y.lang = p.lang and y.m = p.m - k and y.phrase = array_to_string(ws[k + 1:], ' ')
), best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as rn from cuts) where rn = 1
), inner_ as (
  select lang, array_to_string(ws[i:i + size - 1], ' ') as phrase, max(a) as outer_
  from (select *, unnest(range(1, m - size + 2)) as i from (select *, unnest(range(2, m)) as size from phrases where m > 2)) group by all
), kept as (select b.* from best b left join inner_ i on i.lang = b.lang and i.phrase = b.phrase where outer_ is null or 100::hugeint * outer_ < 80::hugeint * a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::bigint)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

_OP13 = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, key) as pos, key, chars
  from (select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key, length(coalesce(text, '')) as chars from conversations where conv_id is not null)
), convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC32} % 6 as h from (select distinct conv_id, conv_id::varchar as s from turns)
), rebuilt as (
  select c.conv_id, 0 as part, pos, key, chars from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all select c.conv_id, 1, pos, key, chars from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
), lists as (select conv_id, list(key order by part, pos) as keys, list(chars order by part, pos) as chars from rebuilt group by 1
), members as (
  select conv_id, len(coalesce(keys, [])) as n, unnest(range(len(coalesce(keys, [])) + 1)) as depth, keys, chars from convs left join lists using (conv_id)
), paths as (
  select conv_id, n, depth, coalesce(array_to_string(keys[1:depth], ''), '') as prefix, case when depth = 0 then 0 else chars[depth] end as last from members
), nodes as (
  select min(conv_id) as conv_id, depth, prefix, count(*) as n_convs, max(last) as last,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from paths group by depth, prefix
), children as (select depth - 1 as depth, left(prefix, length(prefix) - 64) as prefix, count(*) as n_children from nodes where depth > 0 group by 1, 2
), counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (depth, prefix)
), below as (
  select y.depth, y.prefix, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum((x.n_convs - 1) * x.last) as saved_tokens
  from counted y join counted x on x.depth >= y.depth and starts_with(x.prefix, y.prefix) group by 1, 2
)
select c.conv_id, cast(c.depth as bigint) as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, c.ends_sha256
from counted c join below using (depth, prefix) left join nodes p on p.depth = c.depth - 1 and p.prefix = left(c.prefix, length(c.prefix) - 64)
"""

ORACLE_SQL: dict[str, str] = {"op12_collocations": _OP12, "op13_prefix_trie": _OP13, "op11_exact_dedup": _OP11, "op8_html_extract": _OP8, "op2_embedding_dedup": _OP2, "op6_minhash": _OP6, "op7_decontaminate": _OP7, "op9_url_filter": _OP9}
