"""The thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import decontam, embedding_dedup, exact_dedup, html_text, langid, mixing, packing, periodic, simhash, spelling, token_files, url_filter
from .common import shared_dir


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    """The language of every whole text of documents, learnt outside the held-out fold. Null text, and text without a letter, is `und`
    with score 0; a null id is in no fold. Repeated rows are each predicted, an empty table gives no row."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    """Every row of documents with the row that stays of its text. Null text is empty; of repeated rows with the largest id one is
    kept; a null id is smaller than any. An empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    rows = exact_dedup.resolve(docs.select("doc_id", exact_dedup.digest("text").alias("digest")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_embedding_near_dedup(spark, sf_dir):
    """Every vector with its links and component. Null labels and unusable vectors link with nothing; a null id never names
    a component that has others; repeated rows link with each other. An empty table gives no row."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark, sf_dir):
    """Every document with its fingerprint and component. Null and empty texts have fingerprint zero and link; a null id never
    names a component that has others; repeated rows come each. An empty table gives no row."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_source_mixing(spark, sf_dir):
    """Every document with what the mix takes of it. Null text has size 0, a null source is one of its own, equal rows are taken
    alike. An empty table gives no row."""
    rows = mixing.assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op6_token_counts(spark, sf_dir):
    """Every document's number of ids and an end id, from flat files. Null text counts 1, repeated rows come each, an empty table
    gives no row."""
    return token_files.token_counts(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    """Every document's place, number and checksum of ids, as read back from the token files. Null text is the end id alone; null
    ids come first, equal ones in the order of a hash of their texts. An empty table gives no row."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_indexed(table(spark, sf_dir, "documents"), folder)
    rows = token_files.read_indexed(spark, folder)
    rows = rows.select("doc_id", "part", "block", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    rows = rows.join(token_files.block_starts(spark, folder), ["part", "block"])
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_main_text(spark, sf_dir):
    """Every page's main text. Null html is empty, a page without a host is decided by itself, repeated rows come each. An empty table
    gives no row."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark, sf_dir):
    """Every page's verdict: a rule's, else the trees', which learn from the pages' urls that a rule decides. A null url is allowed;
    repeated rows come each. An empty table gives no row."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_packing(spark, sf_dir):
    """The pieces of all documents in sequences of 1024 tokens. Null text is the end id alone; repeated rows are documents of their
    own. An empty table gives no row."""
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_decontamination(spark, sf_dir):
    """Every document with its words inside windows of benchmark items, and those items. Null texts have no words, items without
    words match nothing; repeated rows come each. An empty table gives no row, an empty benchmark no hit."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark, sf_dir):
    """Every document with its runs of words that repeat with a period. Null text has no words, a null id plants no repeats;
    repeated rows come each. An empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    return periodic.runs(docs, plant=F.crc32(F.col("doc_id").cast("string")))


def op13_spelling_variants(spark, sf_dir):
    """Every word of documents with its near words and the form that it varies. Null text has no words, a null id counts as
    empty in what loses a letter; repeated rows count each. An empty table gives no row."""
    return spelling.variants(spelling.counted(table(spark, sf_dir, "documents"), typo=199))


def pipeline(spark, sf_dir):
    """The pieces that corpus_pipeline's five stages make of documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_main_text": op8_main_text,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op3_embedding_near_dedup": """
        with recursive t as (select *, row_number() over (order by vec_id) as row from embeddings),
        v as (select row, label, list_transform(embedding, lambda x: coalesce(x, 0)::double) as e from t
              where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.row as a, b.row as b from v a join v b on a.label = b.label and a.row <> b.row
              where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.98 else false end),
        r as (select row as n, row as c from t union select l.b, r.c from r join l on l.a = r.n where r.c < l.b)
        select e.vec_id, (select count(*) from l where l.a = e.row) as n_links, o.vec_id as component_id, e.vec_id = o.vec_id as kept
        from t e join (select n, min(c) as c from r group by n) m on m.n = e.row join t o on o.row = m.c""",
    "op11_decontamination": r"""
        with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as t
               from (select *, unnest(range(1, len(w) - size + 2)) as i from (select *, least(len(w), 10) as size from b where len(w) > 0))),
        dw as (select row, i, size, array_to_string(w[i:i + size - 1], ' ') as t
               from (select *, unnest(range(1, len(w) - size + 2)) as i from d cross join (select distinct size from bw) where len(w) >= size)),
        o as (select row, i, dw.size, item_id from dw join bw on dw.t = bw.t and dw.size = bw.size),
        h as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + size)) as p from (select distinct row, i, size from o)) group by row),
        n as (select row, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct row, item_id::varchar as k from o where item_id is not null) group by row)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (row) left join n using (row)""",
    "op13_spelling_variants": r"""
        with r as (select run, coalesce(doc_id::varchar, '') || ':' || run as key, count(*) as k
                   from (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
                   where length(run) >= 6 group by all),
        t0 as (select list(crc order by b) as crc from (
          select b, list_reduce(list_concat([b], range(0, 8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as crc from (select unnest(range(0, 256)) as b))),
        h as (select run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode(key)) + 1), lambda i: ('0x' || substr(hex(encode(key)), 2 * i - 1, 2))::bigint)),
                                             lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1])), 4294967295) as h from r, t0),
        w as (select word, sum(k)::bigint as n from (
          select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h) where length(word) >= 6 group by word having sum(k) >= 5),
        v as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
        p as (select a.word, b.word as o, b.n as o_n from v a join v b on a.less = b.less and a.i = b.i and a.word <> b.word
              union select a.word, b.word, b.n from v a join w b on a.less = b.word union select b.word, a.word, a.n from v a join w b on a.less = b.word),
        f as (select word, count(*) as n_near, max(o_n) as form_n, arg_min(o, (-o_n, o)) as form from p group by word),
        z as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n from w left join f on f.word = w.word),
        c as (with recursive s as (select word, word as root, form from z union all select s.word, z.word, z.form from s join z on z.word = s.form) select word, root from s where form is null)
        select z.word, form, root, n, n_near, form_n from z join c on c.word = z.word""",
}
