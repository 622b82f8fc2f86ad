"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat, decontamination, embeddings, html, line_dedup, merkle, minhash, packing, pii, toxicity, urls, warc, whitening
from helixframe.plans.staging import staged, table


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The JSON text of one of the machine's public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = urls.listed_labels(pages, URL_RULES)
    rules = urls.mined(pages, labels, label_id="id", bad="bad")
    return urls.judge(pages, rules, URL_RULES)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = staged(warc.read(spark, warc.write(pages)).withColumn("page", F.col("page").cast(kind)))
    return warc.resolved(found).select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = staged(toxicity.fit(docs, labels))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines with words, how many of them stay, and the digest of what stays."""
    marked = line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("kept_text", F.lit(""))
    return marked.select("row.doc_id", "n_lines", "n_kept", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    out = chat.formatted(chat.format_chats(turns.unionByName(odd)))
    read = out.select("conv_id", "valid", chat.loss_text().alias("learned"), chat.parsed("text").alias("turns"), F.length("text").alias("n"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded again from a copy of the table in which half of the texts lost their line ends."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, fields, group="source", order="doc_id", changed={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, staged(pii.fit(docs)))
    return found.select("doc_id", *[pii.count(kind).alias(f"n_{kind}") for kind in pii.KINDS], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


QUERIES = {
    "op1_html": op1_html,
    "op2_urls": op2_urls,
    "op3_warc": op3_warc,
    "op4_embeddings": op4_embeddings,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash": op7_minhash,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_pii": op13_pii,
}
#: The control strings of the chat template, with a backslash behind the first character when escaped.
_MARKS = r"(\[|<)(/?(?:SYS|INST|OUT|ROLE|TURN)\]|/s>)"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: Least node reachable from each, from links both ways.
_REACH = """r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)"""



def _hashed_part(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_hashed_part(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_TAMPERED = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q
    """,
    "op6_line_dedup": """
        WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(0, len(lines))) AS no, unnest(lines) AS line FROM docs),
        w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '') AS words FROM l),
        f AS (SELECT words, len(words) AS n, min(struct_pack(d := doc_id, no := no)) AS place FROM w WHERE len(words) > 0 GROUP BY words),
        v AS (SELECT words, place, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8)),
        near AS (
            SELECT a.words FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i WHERE b.place < a.place
            UNION SELECT a.words FROM v a JOIN f b ON a.rest = b.words AND b.n >= 8 WHERE b.place < a.place
            UNION SELECT a.words FROM f a JOIN v b ON b.rest = a.words AND a.n >= 8 WHERE b.place < a.place
        ),
        kept AS (SELECT place.d AS doc_id, place.no AS no FROM f WHERE words NOT IN (SELECT words FROM near)),
        t AS (
            SELECT w.doc_id, count(*) FILTER (len(words) > 0) AS n_lines, count(kept.no) AS n_kept,
                   string_agg(line, chr(10) ORDER BY w.no) FILTER (len(words) = 0 OR kept.no IS NOT NULL) AS text
            FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id AND w.no = kept.no GROUP BY w.doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept,
               CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(t.text, '')) AS text_sha256
        FROM docs d LEFT JOIN t ON d.doc_id = t.doc_id
    """,
    "op8_chat": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        e AS (
            SELECT *, length(regexp_replace(replace(text, '\\', '\\\\'), '{_MARKS}', '\\1\\\\\\2', 'g')) AS n,
                   CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 END AS marks
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + marks) AS BIGINT) AS formatted_chars,
               regexp_full_match(string_agg(role, ' ' ORDER BY turn), '(system )?user( assistant user)*( assistant)?') AS valid
        FROM e GROUP BY conv_id
    """,
    "op4_embeddings": f"""
        WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
        {_REACH},
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_, 0) AS n_links, coalesce(least(vec_id, low), vec_id) AS component_id, coalesce(least(vec_id, low), vec_id) = vec_id AS kept
        FROM (SELECT vec_id, k.n AS n_, c.low FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id)
    """,
    "op7_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        g AS (SELECT DISTINCT doc_id, words[i:i + 3] AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        l AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 80 * (x.n + y.n - m)
        ),
        {_REACH}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, low), d.doc_id) AS component_id, coalesce(least(d.doc_id, low), d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
        bw AS (SELECT DISTINCT item_id, words[i:i + 9] AS s FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
        k AS (SELECT DISTINCT len(s) AS k FROM bw),
        dw AS (SELECT doc_id, i, k, words[i:i + k - 1] AS s FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, k WHERE len(words) >= k)),
        h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (s)),
        p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op12_merkle": f"""
        WITH RECURSIVE c AS (SELECT *, {_CRC} AS crc FROM documents),
        d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text=_TAMPERED)} AS changed FROM c),
        p AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
        low(source, lvl, i, n, h) AS (
            SELECT source, 0, place, n, leaf FROM p
            UNION ALL SELECT source, lvl + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, lvl, i // 3
        ),
        g AS (SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
        high(lvl, i, n, h) AS (
            SELECT 0, place, n, subroot FROM g
            UNION ALL SELECT lvl + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3
        ),
        nodes AS (SELECT place AS tree, l.lvl, l.i, l.n, h FROM low l JOIN g ON l.source IS NOT DISTINCT FROM g.source UNION ALL SELECT -1, lvl, i, n, h FROM high),
        way AS (
            SELECT p.row, x.lvl AS step, x.tree, x.lvl, x.i FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source JOIN nodes x ON x.tree = g.place AND x.n > 1 AND x.i = p.place // CAST(pow(3, x.lvl) AS BIGINT)
            UNION ALL
            SELECT p.row, g.depth + x.lvl, x.tree, x.lvl, x.i FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source JOIN nodes x ON x.tree = -1 AND x.n > 1 AND x.i = g.place // CAST(pow(3, x.lvl) AS BIGINT)
        ),
        proofs AS (SELECT row, sha256(coalesce(string_agg(x.h, '' ORDER BY step, x.i) FILTER (x.i <> way.i), '')) AS proof FROM way JOIN nodes x ON x.tree = way.tree AND x.lvl = way.lvl AND x.i // 3 = way.i // 3 GROUP BY row),
        fold(row, step, h) AS (
            SELECT row, 0, changed FROM p
            UNION ALL
            SELECT f.row, f.step + 1, sha256(string_agg(CASE WHEN x.i = w.i THEN f.h ELSE x.h END, '' ORDER BY x.i))
            FROM fold f JOIN way w ON w.row = f.row AND w.step = f.step JOIN nodes x ON x.tree = w.tree AND x.lvl = w.lvl AND x.i // 3 = w.i // 3 GROUP BY f.row, f.step
        ),
        ends AS (SELECT row, arg_max(h, step) AS folded_root FROM fold GROUP BY row),
        top AS (SELECT h AS root FROM high WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source JOIN ends ON ends.row = p.row LEFT JOIN proofs ON proofs.row = p.row, top
    """,
}
