"""The queries of this subpackage, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from scholium.llm import bpe, exact_dedup, license_rules, licenses, merkle, mixing, quality, sharding, simhash, spelling, substring_dedup, suffix_dedup, token_files, toxicity
from scholium.llm.common import load


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated_bytes(load(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op6_sharding(spark, sf_dir):
    return sharding.shard(load(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    return token_files.round_trip(load(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.score(load(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return bpe.encode_documents(load(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(load(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.tamper_trial(load(spark, sf_dir, "documents"))


def op13_license_scan(spark, sf_dir):
    return licenses.scan(load(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The table of CRC-32 as a list, one entry per byte.
CRC_TABLE = """
    crc AS (SELECT list(v ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS v FROM range(256) AS r(i)))"""


def crc32_sql(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, where ``crc`` is joined."""
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295))"


def merkle_sql(depth: int = 9, fanout: int = 16) -> str:
    """The manifest's rows, for trees of up to fanout ** depth leaves."""

    def levels(name: str) -> str:
        made = []
        for k in range(depth):
            window = f"(PARTITION BY grp, idx // {fanout} ORDER BY idx ROWS BETWEEN"
            made.append(f"""
        {name}s{k} AS (SELECT grp, idx, n, coalesce(string_agg(d, '') OVER {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                              coalesce(string_agg(d, '') OVER {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),
        {name}{k + 1} AS (SELECT grp, idx // {fanout} AS idx, (any_value(n) + {fanout - 1}) // {fanout} AS n,
                                 CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d
                          FROM {name}{k} GROUP BY grp, idx // {fanout})""")
        return ",".join(made)

    def climbed(start: str, name: str, frm: str, group: str, place: str) -> str:
        made, last = [], start
        for k in range(depth):
            made.append(f"""
        {frm}{name}{k} AS (SELECT p.* EXCLUDE (proof, fold), p.proof || s.b || s.a AS proof, CASE WHEN s.n > 1 THEN sha256(s.b || p.fold || s.a) ELSE p.fold END AS fold
                      FROM {last} p JOIN {name}s{k} s ON s.grp = p.{group} AND s.idx = p.{place} // {fanout**k})""")
            last = f"{frm}{name}{k}"
        return ",".join(made)

    fields = "".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" + " || " for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ids = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"""
        WITH {CRC_TABLE.strip()},
        r AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, sha256({fields}coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
                     CASE WHEN {crc32_sql(ids)} % 5 = 0 THEN sha256({fields}coalesce(strlen({lower})::VARCHAR || ':' || {lower}, '-')) END AS shown
              FROM documents, crc),
        d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM r),
        l0 AS (SELECT grp, idx, count(*) OVER (PARTITION BY grp) AS n, leaf AS d FROM d),{levels("l")},
        g AS (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gidx FROM l{depth}),
        t0 AS (SELECT 1 AS grp, gidx AS idx, count(*) OVER () AS n, subroot AS d FROM g),{levels("t")},
        p AS (SELECT d.doc_id, d.leaf, g.subroot, d.grp, d.idx, g.gidx, 1 AS one, '' AS proof, coalesce(shown, leaf) AS fold FROM d JOIN g USING (grp)),{climbed("p", "l", "p", "grp", "idx")},{climbed(f"pl{depth - 1}", "t", "p", "one", "gidx")}
        SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified
        FROM pt{depth - 1}, t{depth}
    """


def license_sql() -> str:
    """The scan's rows. Words have two spaces between them here: a match takes one on each side, as RE2 looks neither back nor ahead."""
    kinds = list(license_rules.KINDS)
    values = ",".join(f"({i}, {kinds.index(r.kind)}, {license_rules.KINDS[r.kind]}::DOUBLE, '{r.keyword}', '{r.label}', ' (?:{r.regex.replace(' ', '  ')}) ')" for i, r in enumerate(license_rules.rules()))
    phrases = ",".join(f"('{label}', {phrase.split()})" for phrase, label in licenses.BASE.items())
    count = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))"
    return rf"""
        WITH rules(rule, kind, sure, keyword, label, regex) AS (VALUES {values}), phrases(label, phrase) AS (VALUES {phrases}),
        d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        t AS (SELECT *, '  ' || array_to_string(words, '  ') || '  ' AS spaced FROM d),
        places AS (SELECT uid, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, phrases),
        base AS (SELECT uid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY uid),
        c AS (SELECT uid, rule, kind, sure, label, string_split_regex(spaced, regex) AS pieces, regexp_extract_all(spaced, regex) AS hits FROM t JOIN rules ON list_contains(words, keyword)),
        m AS (SELECT uid, rule, kind, sure, label, unnest(range(len(hits))) AS pos, unnest(list_transform(pieces[1 : len(hits)], lambda x: {count.format("x")})) AS gap,
                     unnest(list_transform(hits, lambda x: {count.format("x")})) AS length FROM c WHERE len(hits) > 0),
        s AS (SELECT *, sum(gap + length) OVER (PARTITION BY uid, rule ORDER BY pos) AS stop FROM m),
        kept AS (SELECT uid, list(DISTINCT label) AS labels, max(sure) AS score FROM s WHERE NOT EXISTS (
                     SELECT 1 FROM s o WHERE o.uid = s.uid AND o.kind <= s.kind AND o.stop - o.length <= s.stop - s.length AND o.stop >= s.stop
                     AND (o.length > s.length OR o.rule < s.rule)) GROUP BY uid)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, kept.labels))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN base USING (uid) LEFT JOIN kept USING (uid)
    """


def spelling_sql() -> str:
    octets = "list_transform(range(len(hex(encode(key))) // 2), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT)"
    return f"""
        WITH RECURSIVE {CRC_TABLE.strip()},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        r AS (SELECT doc_id, run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS times FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
        h AS (SELECT run, times, {crc32_sql(octets)} AS h FROM r, crc),
        slips AS (SELECT times, CASE WHEN h % {spelling.SLIP_EVERY} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM h),
        words AS (SELECT word, sum(times)::BIGINT AS n FROM slips WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}),
        places AS (SELECT word, unnest(range(length(word))) AS pos FROM words),
        cut AS (SELECT word, pos, word[: pos] || word[pos + 2 :] AS rest FROM places),
        near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
                 UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
                 UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
        best AS (SELECT near.word, other, words.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS place
                 FROM near JOIN words ON words.word = near.other),
        forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.TIMES} * words.n THEN other END AS form,
                         CASE WHEN form_n >= {spelling.TIMES} * words.n THEN form_n END AS form_n
                  FROM words LEFT JOIN best ON best.word = words.word AND place = 1),
        climb AS (SELECT word, word AS root FROM forms UNION ALL SELECT climb.word, forms.form FROM climb JOIN forms ON forms.word = climb.root WHERE forms.form IS NOT NULL),
        ends AS (SELECT climb.word, climb.root FROM climb JOIN forms ON forms.word = climb.root WHERE forms.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """


QUERIES = {
    "pipeline": pipeline,
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op11_spelling_variants": spelling_sql(),
    "op13_license_scan": license_sql(),
    "op12_merkle_manifest": merkle_sql(),
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op3_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS key
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM d GROUP BY source),
        f AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, source_size, least(weight * coalesce((SELECT arg_min(level, 3.0::DOUBLE * source_size / weight) FROM f
                                                WHERE level < 3.0::DOUBLE * source_size / weight), 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size) AS target
            FROM f),
        k AS (
            SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
                   sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto,
                   sum(size) OVER (PARTITION BY d.source, key) AS same
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN target - whole * source_size > 0 AND 2 * upto - same <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM k
    """,
}
