"""SQL with the same results as the registered queries, over the same tables.

It is written against the definitions, not against the Spark plans: ranks are one window over the
table, packing is a recursive walk, similarities are all pairs.
"""

from __future__ import annotations

from .registry import BLOCK, DEV, TEST, TRAIN_CAP
from .derived import SMALL_VOCAB

B = BLOCK
# Fixed values, spelt here again so that a wrong one in an operator shows.
WORD_MARK = "\u2581"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = " " * len(WHITESPACE)
REJECTED = "'noisy', 'header', 'footer', 'short_sentences', 'tiny', 'adult'"
SCRIPTS = (
    "Latin Common Inherited Greek Cyrillic Armenian Hebrew Arabic Devanagari Bengali Tamil Telugu Thai Georgian Hangul Ethiopic "
    "Hiragana Katakana Han Coptic Nko Tifinagh Javanese Sundanese"
).split()


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def pieces(text: str) -> str:
    folded = f"translate({strip(text)}, '{WHITESPACE}', '{BLANKS}')"
    marked = f"'{WORD_MARK}' || regexp_replace({folded}, ' +', ' {WORD_MARK}', 'g')"
    apart = rf"regexp_replace({marked}, '([0-9])', ' \1 ', 'g')"
    return f"CASE WHEN {folded} = '' THEN [] ELSE list_filter(string_split({apart}, ' '), lambda p: p <> '') END"


def key(seed: str, ident: str) -> str:
    return f"md5('{seed}:' || {ident})"


def normal(seed: int, ident: str, dim: str) -> str:
    k = f"md5('{seed}:' || {ident} || ':' || ({dim} // 4))"
    first = f"(1 + 16 * (({dim} % 4) // 2))"
    u = f"(('0x' || substr({k}, {first}, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"
    a = f"(2 * pi() * ((('0x' || substr({k}, {first} + 8, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))"
    return f"(sqrt(-2::DOUBLE * ln({u})) * CASE WHEN {dim} % 2 = 0 THEN cos({a}) ELSE sin({a}) END)"


def millionths(value: str) -> str:
    return f"round({value} * 1000000)::BIGINT"


# --- documents ---

WARNED = """warned AS (
  SELECT *, CASE WHEN doc_id % 3 <> 0 THEN list_append(list_filter([
      CASE WHEN n_chars < 300 THEN 'tiny' END, CASE WHEN doc_id % 5 = 1 THEN 'noisy' END,
      CASE WHEN doc_id % 7 = 2 THEN 'adult' END, CASE WHEN doc_id % 4 = 1 THEN 'curated' END], lambda m: m IS NOT NULL),
      CASE WHEN doc_id % 2 = 0 THEN 'long_lines' END) END AS warnings
  FROM documents)"""
LINES = """lines AS (
  SELECT lang AS source_id, doc_id * 2147483648 + pos - 1 AS line_no, text FROM (
    SELECT doc_id, lang, unnest(ls) AS text, generate_subscripts(ls, 1) AS pos FROM (
      SELECT doc_id, lang, list_append(list_transform(string_split(text, chr(10)), lambda p: p || chr(10)), chr(10)) AS ls FROM documents)))"""
RAGGED = """ragged AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 5 THEN chr(10) WHEN doc_id % 17 = 7 THEN ' ' || chr(9) || chr(10)
    WHEN doc_id % 4 = 0 THEN ' ' || chr(9) || text || chr(10) || chr(10)
    WHEN doc_id % 4 = 1 THEN ' ' || text || '　'
    WHEN doc_id % 4 = 2 THEN ' ' || chr(10) || text || chr(13) || chr(10) ELSE text END AS text
  FROM documents)"""
RANKED = f"ranked AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY {key('42', 'doc_id')}) - 1 AS r, count(*) OVER () AS n FROM documents)"
GROUPED_LINES = """grouped AS (
  SELECT source_id, doc_no, coalesce(string_agg(CASE WHEN text <> chr(10) THEN text END, '' ORDER BY line_no), '') AS text FROM (
    SELECT *, coalesce(sum(CASE WHEN text = chr(10) THEN 1 ELSE 0 END)
      OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_no FROM lines)
  GROUP BY source_id, doc_no HAVING bool_or(text = chr(10)))"""

# --- vocabulary and tokens ---

WORDS = f"""words AS (
  SELECT doc_id, lang, source, unnest(ps) AS token, generate_subscripts(ps, 1) AS pos FROM (
    SELECT doc_id, lang, source, {pieces('text')} AS ps FROM documents))"""


def vocab(name: str, size: int = 32768, lang: str | None = None) -> str:
    where = f"WHERE lang = '{lang}'" if lang else ""
    return f"""{name} AS (
  SELECT token, id::INTEGER AS id FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 259 AS id
    FROM words {where} GROUP BY token) WHERE id < {max(size, 260)})"""


def token_rows(name: str, words: str, vocab_name: str, bos: bool = False, eos: bool = False) -> str:
    ids = "flatten(list(piece_ids ORDER BY pos))"
    if bos:
        ids = f"list_concat([1], {ids})"
    if eos:
        ids = f"list_append({ids}, 2)"
    return f"""{name} AS (
  SELECT doc_id, ids, len(ids) AS len FROM (SELECT doc_id, {ids} AS ids FROM (
    SELECT w.doc_id, w.pos, CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE
      list_transform(range(0, len(hex(w.token)) // 2), lambda i: (('0x' || substr(hex(w.token), 2 * i + 1, 2))::UBIGINT + 4)::INTEGER) END AS piece_ids
    FROM {words} w LEFT JOIN {vocab_name} v USING (token)) GROUP BY doc_id))"""


TOKENS = [WORDS, vocab("v", SMALL_VOCAB), token_rows("tok", "words", "v")]
TOKEN_TEXT = "SELECT doc_id, len::INTEGER AS len, array_to_string(ids, ',') AS ids FROM "
OFFSETS = """offs AS (
  SELECT doc_id, ids, len, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx,
    coalesce(sum(len) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tok)"""
CLIPPED_WORDS = f"""clipped_words AS (
  SELECT doc_id, unnest(ps) AS token, generate_subscripts(ps, 1) AS pos FROM (
    SELECT doc_id, {pieces("array_to_string(string_split(text, ' ')[1:64], ' ')")} AS ps FROM documents))"""

# --- packing ---

PACK = f"""short AS (SELECT doc_id, len, {key('42', 'doc_id')} AS k, row_number() OVER (ORDER BY {key('42', 'doc_id')}) AS rn FROM tok WHERE len <= {B}),
walk(rn, doc_id, k, carry, chunk, closed) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT s.rn, s.doc_id, s.k, CASE WHEN w.carry + s.len >= {B + 1} THEN 0 ELSE w.carry + s.len END,
    w.chunk + w.closed, CASE WHEN w.carry + s.len >= {B + 1} THEN 1 ELSE 0 END
  FROM walk w JOIN short s ON s.rn = w.rn + 1),
members AS (
  SELECT 2 * chunk AS sample_id, doc_id, k FROM walk WHERE doc_id IS NOT NULL AND chunk < (SELECT sum(closed) FROM walk)
  UNION ALL SELECT 2 * doc_id + 1, doc_id, {key('42', 'doc_id')} FROM tok WHERE len > {B})"""


REPORT = f"""SELECT count(*) AS samples, (SELECT count(*) FROM tok) AS docs_in, sum(d)::BIGINT AS docs_used, max(d) AS max_docs,
      sum(least(t, {B + 1}))::BIGINT AS tokens_used, ((SELECT sum(len) FROM tok) - sum(least(t, {B + 1})))::BIGINT AS tokens_dropped,
      round(sum(least(t, {B + 1})) / (count(*) * {B + 1}), 6) AS fill
      FROM (SELECT sample_id, count(*) AS d, sum(len) AS t FROM members JOIN tok USING (doc_id) GROUP BY sample_id)"""


def ensured(ids: str, bos: bool, eos: bool) -> str:
    if bos:
        ids = f"CASE WHEN {ids}[1] IS NOT DISTINCT FROM 1 THEN {ids} ELSE list_concat([1], {ids}) END"
    if eos:
        ids = f"CASE WHEN ({ids})[-1] IS NOT DISTINCT FROM 2 THEN {ids} ELSE list_append({ids}, 2) END"
    return ids


def masked(x: str, y: str) -> str:
    return f"list_transform(range(1, len({y}) + 1), lambda i: CASE WHEN {y}[i] IN (1, 2, 3) OR {x}[i] = 3 THEN -1 ELSE {y}[i] END)"


def padded(values: str, filler: int) -> str:
    return f"list_concat({values}, list_transform(range(0, greatest({B} - len({values}), 0)), lambda i: {filler}))"


def packed(bos: bool, eos: bool) -> list[str]:
    return [
        f"marked AS (SELECT m.sample_id, m.k, {ensured('t.ids', bos, eos)} AS ids FROM members m JOIN tok t USING (doc_id))",
        """numbered AS (SELECT sample_id, k, ids, row_number() OVER (PARTITION BY sample_id ORDER BY k) AS seg FROM marked)""",
        """datas AS (SELECT sample_id, flatten(list(ids ORDER BY k)) AS data,
          flatten(list(list_transform(ids, lambda i: seg) ORDER BY k)) AS segs FROM numbered GROUP BY sample_id)""",
        f"""shaped AS (SELECT sample_id, {padded(f'data[1:{B}]', 3)} AS x, {padded(f'data[2:{B + 1}]', -1)} AS y,
          {padded(f'segs[1:{B}]', 0)} AS s FROM datas)""",
        f"""sampled AS (SELECT sample_id, x AS input_ids, {masked('x', 'y')} AS labels,
          list_transform(range(1, {B} + 1), lambda i: CASE WHEN x[i] = 3 THEN 0 ELSE s[i] END) AS segment_ids FROM shaped)""",
    ]


def lists(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in columns)


def single(access: str) -> str:
    data = f"({ensured('ids', False, True)})" + ("" if access == "full" else f"[1:{B + 1}]")
    x, y = "data[1:len(data) - 1]", "data[2:len(data)]"
    if access == "padded":
        x, y = padded(x, 3), padded(y, -1)
    return (
        with_(*TOKENS, f"cut AS (SELECT doc_id AS sample_id, {data} AS data FROM tok)", f"s AS (SELECT sample_id, {x} AS x, {y} AS y FROM cut)")
        + f"SELECT sample_id, array_to_string(x, ',') AS input_ids, array_to_string({masked('x', 'y')}, ',') AS labels FROM s"
    )


# --- vocabulary transfer ---

TRANSFER = [
    WORDS,
    vocab("src_vocab", lang="en"),
    vocab("tgt", lang="de"),
    "src AS (SELECT v.token, v.id, e.embedding::DOUBLE[] AS vec FROM src_vocab v JOIN embeddings e ON e.vec_id = v.id - 260)",
    "src_long AS (SELECT token, id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM src)",
    "width AS (SELECT max(len(vec)) AS w FROM src)",
    "dims AS (SELECT unnest(range(0, (SELECT w FROM width)))::BIGINT AS dim)",
    "stats AS (SELECT dim, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std FROM src_long GROUP BY dim)",
]
RANDOM = f"random_long AS (SELECT t.token, t.id, d.dim, {normal(42, 't.id', 'd.dim')} * 0.02::DOUBLE AS v FROM tgt t, dims d)"
MEAN = f"mean_long AS (SELECT t.token, t.id, s.dim, s.mean + s.std * {normal(42, 't.id', 's.dim')} AS v FROM tgt t, stats s)"
IDENTITY = """identity_long AS (SELECT t.token, t.id, s.dim, s.v FROM tgt t JOIN src_long s USING (token)
  WHERE t.token NOT IN ('<s>', '</s>', '<unk>', '<pad>', '<mask>'))"""


def vectors(source: str, extra: str = "") -> str:
    cols = f"token, id{extra}"
    return f"SELECT {cols}, string_agg({millionths('v')}::VARCHAR, ',' ORDER BY dim) AS vec FROM {source} GROUP BY {cols}"


SCRIPT_CASE = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(c, '^\\p{{{s}}}') THEN '{s}'" for s in SCRIPTS)
    + " ELSE 'UNK' END"
)


def script_parts(source: str, name: str) -> list[str]:
    bare = f"CASE WHEN starts_with(token, '{WORD_MARK}') AND length(token) > 1 THEN substr(token, 2) ELSE token END"
    return [
        f"{name}_chars AS (SELECT token, id, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM (SELECT token, id, string_split({bare}, '') AS cs FROM {source}))",
        f"{name}_counts AS (SELECT token, id, {SCRIPT_CASE} AS script, count(*) AS n, min(pos) AS first FROM {name}_chars WHERE c <> '' GROUP BY ALL)",
        f"{name}_script AS (SELECT token, id, script FROM {name}_counts QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1)",
        f"""{name}_groups AS (SELECT token, id, script || CASE WHEN starts_with(token, '{WORD_MARK}') THEN '_initial' ELSE '_medial' END AS category FROM {name}_script
          UNION ALL SELECT token, id, 'special' FROM {name}_script WHERE token IN ('<s>', '</s>', '<unk>', '<pad>', '<mask>'))""",
    ]


BY_SCRIPT = [
    *script_parts("src", "s"),
    *script_parts("tgt", "t"),
    """cat_stats AS (SELECT g.category, l.dim, avg(l.v) AS mean, coalesce(stddev_samp(l.v), 0) AS std
      FROM s_groups g JOIN src_long l USING (id) WHERE g.category <> 'special' GROUP BY ALL)""",
    f"""script_long AS (SELECT g.token, g.id, c.dim, c.mean + c.std * {normal(42, 'g.id', 'c.dim')} AS v
      FROM t_groups g JOIN cat_stats c USING (category))""",
]


def aux(name: str, lang: str) -> str:
    slots = ", ".join(f"sum(CASE WHEN slot = {i} THEN 1 ELSE 0 END)::DOUBLE" for i in range(20))
    return f"""{name} AS (SELECT token, [{slots}] AS aux FROM (
      SELECT token, regexp_extract(source, '([0-9]+)', 1)::INTEGER % 20 AS slot FROM words WHERE lang = '{lang}')
      GROUP BY token HAVING count(*) >= 10)"""


OVERLAP = [
    aux("aux_de", "de"),
    "copied AS (SELECT t.token, t.id, s.id AS sid FROM tgt t JOIN src s USING (token))",
    "keys AS (SELECT c.id, c.sid, a.aux FROM copied c JOIN aux_de a USING (token))",
    "others AS (SELECT t.id, a.aux FROM tgt t JOIN aux_de a USING (token) WHERE t.id NOT IN (SELECT id FROM copied))",
    "sims AS (SELECT o.id, k.sid, list_cosine_similarity(o.aux, k.aux) AS z FROM others o, keys k)",
    "steps AS (SELECT *, row_number() OVER w AS k, sum(z) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM sims WINDOW w AS (PARTITION BY id ORDER BY z DESC))",
    "taus AS (SELECT id, arg_max((cs - 1) / k, k) AS tau FROM steps WHERE 1 + k * z > cs GROUP BY id)",
    "weights AS (SELECT s.id, s.sid, s.z - t.tau AS w FROM sims s JOIN taus t USING (id) WHERE s.z > t.tau)",
    "weighted AS (SELECT w.id, l.dim, sum(w.w * l.v) AS v FROM weights w JOIN src_long l ON l.id = w.sid GROUP BY ALL)",
    """overlap_long AS (
      SELECT t.token, t.id, 'copied' AS kind, l.dim, l.v FROM copied t JOIN src_long l ON l.id = t.sid
      UNION ALL SELECT t.token, t.id, 'weighted', w.dim, w.v FROM tgt t JOIN weighted w USING (id)
      UNION ALL SELECT m.token, m.id, 'drawn', m.dim, m.v FROM mean_long m
        WHERE m.id NOT IN (SELECT id FROM copied) AND m.id NOT IN (SELECT id FROM weighted))""",
]

# --- evaluation ---


def scored(name: str, token_table: str, all_tokens: str, size: int) -> list[str]:
    return [
        f"{name}_n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT unnest(ids) AS label FROM {all_tokens}) GROUP BY label)",
        f"{name}_nll AS (SELECT label, -ln((n + 1)::DOUBLE / (t + {size})::DOUBLE) AS nll FROM {name}_n)",
        f"""{name} AS (SELECT p.batch_id, p.doc_id, p.label, s.nll FROM (
          SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id, doc_id, ids FROM {token_table}) q,
          LATERAL (SELECT q.batch_id, q.doc_id, unnest(q.ids) AS label) p JOIN {name}_nll s USING (label))""",
    ]


def nll(cap: int) -> str:
    where = "" if cap == -1 else f"WHERE batch_id < {cap // 16}"
    return f"""SELECT count(*) AS batches, sum(n)::BIGINT AS tokens, round(avg(nll / n), 6) AS loss, round(exp(avg(nll / n)), 6) AS perplexity,
      round(sum(nll) / sum(n), 6) AS per_token_nll, round(sum(nll) / (count(*) * 16), 6) AS per_doc_nll,
      round(exp(sum(nll) / sum(n)), 6) AS token_perplexity, {cap} AS cap
      FROM (SELECT batch_id, sum(nll) AS nll, count(*) AS n FROM scored {where} GROUP BY batch_id)"""


# --- telemetry ---

TELEMETRY = """tele AS (
  SELECT user_id % 8 AS run_id, (user_id // 8) % 2 AS device, event_type, event_id, 1 AS samples,
    regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS tokens, (round(value * 100) + 1) / 1024::DOUBLE AS train_s, (round(value * 100) + 9) / 1024::DOUBLE AS e2e_s,
    regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT * 6000000000::DOUBLE AS flops,
    row_number() OVER (PARTITION BY user_id % 8, (user_id // 8) % 2 ORDER BY event_id) - 1 AS step FROM events)"""


def rates(world: int, window: int) -> str:
    cols = []
    for suffix, seconds in (("", "train_s"), ("_e2e", "e2e_s")):
        for name, amount in (("batches", "count(*)"), ("samples", "sum(samples)"), ("tokens", "sum(tokens)"), ("tflops", "1e-12::DOUBLE * sum(flops)")):
            rate = f"CASE WHEN count(*) OVER w = {window} THEN {amount} OVER w / sum({seconds}) OVER w END"
            cols.append(f"round({rate}, 6) AS device_{name}_per_sec{suffix}")
            cols.append(f"round({rate} * {world}, 6) AS {name}_per_sec{suffix}")
    return (
        with_(TELEMETRY)
        + f"SELECT run_id, device, step, {', '.join(cols)} FROM tele WINDOW w AS (PARTITION BY run_id, device ORDER BY step ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    )


PEAKS = """peaks(device_class, p, peak) AS (VALUES
  ('h100-sxm', '32-true', 67e12::DOUBLE), ('h100-sxm', '16-mixed', 989.5e12), ('h100-sxm', 'bf16-true', 989.5e12), ('h100-sxm', 'bf16-mixed', 989.5e12),
  ('h100-sxm', '8-mixed', 1979e12), ('h100-pcie', '32-true', 51e12), ('h100-pcie', '16-mixed', 756.5e12), ('h100-pcie', 'bf16-true', 756.5e12),
  ('h100-pcie', 'bf16-mixed', 756.5e12), ('h100-pcie', '8-mixed', 1513e12), ('a100', '32-true', 19.5e12), ('a100', '16-mixed', 312e12),
  ('a100', 'bf16-true', 312e12), ('a100', 'bf16-mixed', 312e12), ('a10g', '32-true', 31.2e12), ('a10g', '16-mixed', 125e12),
  ('a10g', 'bf16-true', 125e12), ('a10g', 'bf16-mixed', 125e12), ('t4', '32-true', 8.1e12), ('t4', '16-mixed', 65e12),
  ('v100s-pcie', '32-true', 16.4e12), ('v100s-pcie', '16-mixed', 130e12), ('v4', 'bf16-true', 275e12), ('v4', 'bf16-mixed', 275e12),
  ('v4', '16-mixed', 275e12), ('v4', '32-true', 275e12), ('v4', '8-mixed', 275e12))"""

# --- tensors ---

TENSORS = """shards AS (
  SELECT ['_forward_module.model.embed_tokens.weight', '_forward_module.lm_head.weight', 'model._orig_mod.norm.weight',
    'model.layers.0._fsdp_wrapped_module.input_layernorm.weight', 'model.layers.0._checkpoint_wrapped_module.self_attn.q_proj.weight'][label % 5 + 1] || '.' || label AS name,
    label AS tensor, label % 2 = 0 AS trainable, embedding::DOUBLE[] AS vals FROM embeddings),
flat AS (SELECT tensor, unnest(vals) AS v FROM shards)"""

# --- logs ---

GRID = {
    "precision": ["bf16-true", "bf16-mixed"],
    "devices": [8, 4, 2],
    "mb": [1, 2, 4, 8],
    "activation_checkpointing": ["true", "false"],
    "fsdp_sharding_strategy": ["FULL_SHARD", "SHARD_GRAD_OP"],
    "gradient_accumulation_no_sync": ["false", "true"],
    "use_paged_adamw": ["true", "false"],
}
_sizes = [len(v) for v in GRID.values()]
_cols, _below = [], 384
for (_name, _values), _size in zip(GRID.items(), _sizes):
    _below //= _size
    _list = ", ".join(repr(v) for v in _values)
    _cols.append(f"[{_list}][(config // {_below}) % {_size} + 1] AS {_name}")
GRID_SQL = f"grid AS (SELECT config, {', '.join(_cols)} FROM (SELECT unnest(range(0, 384)) AS config))"
AXES = list(GRID)
LOGS = [
    GRID_SQL,
    """named AS (
  SELECT e.event_id // 12 AS f, e.event_id % 12 + 1 AS step, g.*,
    regexp_extract(e.props, '"k": *([0-9]+)', 1)::BIGINT AS k, round(e.value * 100)::BIGINT // 5 + 50 AS cs
  FROM events e JOIN grid g ON g.config = (e.event_id // 12) % 384)""",
    """rendered AS (
  SELECT f, step, 'r' || (f // 384) || '-run-' || precision || '-g' || devices || '---mb-' || mb || '---activation_checkpointing-' || activation_checkpointing
    || '---fsdp_sharding_strategy-' || fsdp_sharding_strategy || '---precision-' || precision || '---gradient_accumulation_no_sync-'
    || gradient_accumulation_no_sync || '---use_paged_adamw-' || use_paged_adamw || '.log' AS file,
    'global_step_time: ' || CASE WHEN cs // 100 < 60 THEN (cs // 100) || '.' || lpad((cs % 100)::VARCHAR, 2, '0') || 's'
      ELSE (cs // 100 // 60) || ':' || lpad(((cs // 100) % 60)::VARCHAR, 2, '0') || 'm' END AS t,
    ', max_cuda_ram: ' || (40 + k % 40) || '.' || lpad(k::VARCHAR, 2, '0') || ' GB' AS ram,
    'optimizer_step: ' || step || ', iter: ' || (step * 4) || ', ' AS head,
    CASE WHEN f % 3 = 0 THEN 'args.num_devices=' || devices ELSE 'starting' END AS first
  FROM named
  WHERE mb * CASE WHEN precision = 'bf16-mixed' THEN 2 ELSE 1 END * CASE WHEN activation_checkpointing = 'false' THEN 2 ELSE 1 END < 4 * devices OR step <= 5)""",
    """bodies AS (
  SELECT file, CASE WHEN step = 1 THEN 0 ELSE 1 + (step - 1) * CASE WHEN f % 2 = 1 THEN 3 ELSE 1 END END AS start,
    list_concat(CASE WHEN step = 1 THEN [first] ELSE [] END,
      CASE WHEN f % 2 = 1 THEN ['Step stats:', head, t || ram] ELSE ['Step stats: ' || head || t || ram] END) AS body FROM rendered)""",
    "lines AS (SELECT file, start + generate_subscripts(body, 1) - 1 AS line_no, unnest(body) AS text FROM bodies)",
    """blocks AS (
  SELECT file, line_no, text, sum(CASE WHEN contains(text, 'Step stats:') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no)::BIGINT AS block,
    try_cast(nullif(regexp_extract(text, 'optimizer_step: ([0-9]+)', 1), '') AS INTEGER) AS step0,
    CASE WHEN regexp_matches(text, 'global_step_time: [0-9.]+s') THEN regexp_extract(text, 'global_step_time: ([0-9.]+)s', 1)::DOUBLE
         WHEN regexp_matches(text, 'global_step_time: [0-9]+:[0-9.]+m') THEN regexp_extract(text, 'global_step_time: ([0-9]+):', 1)::DOUBLE * 60
           + regexp_extract(text, 'global_step_time: [0-9]+:([0-9.]+)m', 1)::DOUBLE END AS time0,
    try_cast(nullif(regexp_extract(text, 'max_cuda_ram: ([0-9.]+) GB', 1), '') AS DOUBLE) AS ram0 FROM lines)""",
    """steps AS (
  SELECT file, block, CASE WHEN max(time0) IS NOT NULL THEN max(step0) END AS step, max(time0) AS time, max(ram0) AS ram FROM (
    SELECT file, block, max(step0) OVER (PARTITION BY file, block) AS step0, time0, ram0 FROM blocks WHERE block > 0)
  GROUP BY file, block)""",
    """kept_steps AS (SELECT file, block, CASE WHEN step BETWEEN 2 AND 11 THEN step END AS step,
    CASE WHEN step BETWEEN 2 AND 11 THEN time END AS time, ram FROM steps WHERE step <= 11)""",
    """configs AS (
  SELECT file, regexp_extract(file, '-(bf16-[a-z]+)-g', 1) AS precision,
    coalesce(max(try_cast(nullif(regexp_extract(text, 'args\\.num_devices=([0-9]+)', 1), '') AS INTEGER)), regexp_extract(file, '-g([0-9]+)---', 1)::INTEGER) AS devices,
    regexp_extract(file, '--mb-([0-9]+)', 1)::INTEGER AS mb, regexp_extract(file, '--activation_checkpointing-([a-z]+)', 1) AS activation_checkpointing,
    regexp_extract(file, '--fsdp_sharding_strategy-([A-Z_]+)', 1) AS fsdp_sharding_strategy,
    regexp_extract(file, '--gradient_accumulation_no_sync-([a-z]+)', 1) AS gradient_accumulation_no_sync,
    regexp_extract(file, '--use_paged_adamw-([a-z]+)', 1) AS use_paged_adamw
  FROM lines GROUP BY file)""",
    """summary AS (
  SELECT *, CASE WHEN NOT oom THEN mean_all END AS mean_s, CASE WHEN NOT oom THEN std_all END AS std_s, CASE WHEN NOT oom THEN ram_all END AS max_ram,
    CASE WHEN NOT oom THEN mean_all * 7680 * devices / 3600 END AS gpu_hours FROM (
    SELECT c.*, coalesce(s.times, 0) < 10 AS oom, s.mean_all, s.std_all, s.ram_all FROM configs c LEFT JOIN (
      SELECT file, count(time) AS times, sum(round(time * 1000)::BIGINT) / 1000 / count(time) AS mean_all, stddev_pop(time) AS std_all, max(ram) AS ram_all FROM kept_steps GROUP BY file) s USING (file)))""",
    """best AS (SELECT precision, devices, file, oom, mean_s, gpu_hours FROM summary
    QUALIFY row_number() OVER (PARTITION BY precision, devices ORDER BY oom, coalesce(mean_s, 0), file) = 1)""",
]
DOMINANCE = " AND ".join(
    f"g.{a} >= f.{a}" if a == "mb" else f"g.{a} <= f.{a}" if a == "devices" else f"(f.{a} = '{GRID[a][0]}' OR f.{a} = g.{a})" for a in AXES
)


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["source_normalise"] = with_(WARNED) + """SELECT doc_id, text, lang, ['mc4', 'cc100', 'oscar2023', 'culturax', 'pile'][doc_id % 5 + 1] AS corpus,
      CASE WHEN doc_id % 5 = 2 THEN array_to_string(list_transform(warnings, lambda w: coalesce(w, '-')), ',') END AS warnings FROM warned"""
    sql["read_slice"] = "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.5)"
    sql["scan_jsonl"] = "SELECT text, count(*) AS n FROM documents GROUP BY text"
    head = f"CASE WHEN r < {DEV} THEN 'dev' WHEN r < {DEV + TEST} THEN 'test' WHEN r < {DEV + TEST + TRAIN_CAP} THEN 'train' END"
    sql["sink_roundtrip"] = with_(RANKED) + f"""SELECT d.lang, s.split, row_number() OVER (PARTITION BY d.lang, s.split, f.format ORDER BY s.r) - 1 AS position,
      d.text, f.format FROM documents d JOIN (
      SELECT doc_id, r, CASE WHEN r < {DEV} THEN 'dev' WHEN r < {DEV + TRAIN_CAP} THEN 'train' END AS split FROM ranked) s USING (doc_id),
      (VALUES ('json'), ('text')) f(format) WHERE s.split IS NOT NULL"""
    sql["materialise_reuse"] = "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(*) AS docs_again FROM documents GROUP BY lang"
    sql["token_shards"] = with_(*TOKENS) + "SELECT count(*) AS docs, sum(len)::BIGINT AS tokens, sum(list_sum(ids))::BIGINT AS id_sum, 0::BIGINT AS overlaps FROM tok"
    sql["token_text"] = f"SELECT doc_id, array_to_string({pieces('text')}, ' ') AS line FROM documents"
    sql["quality_filter"] = with_(WARNED) + f"""SELECT doc_id, lang FROM warned
      WHERE warnings IS NULL OR len(list_filter(warnings, lambda w: coalesce(w IN ({REJECTED}), false))) = 0"""
    sql["lines_to_docs"] = with_(LINES, GROUPED_LINES) + "SELECT * FROM grouped"
    sql["normalise_text"] = with_(RAGGED) + f"SELECT doc_id, {strip('text')} || chr(10) AS text FROM ragged WHERE text <> chr(10)"
    sql["clip_words"] = "SELECT doc_id, array_to_string(string_split(text, ' ')[1:64], ' ') AS text FROM documents"

    sql["shuffle_global"] = with_(RANKED) + "SELECT doc_id, text, r AS position FROM ranked"
    sql["shuffle_buffered"] = f"""WITH s AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS b FROM documents)
      SELECT doc_id, text, b * 100 + row_number() OVER (PARTITION BY b ORDER BY {key('42', 'doc_id')}) - 1 AS position FROM s"""
    sql["pre_discard"] = with_(RANKED) + "SELECT doc_id, lang FROM ranked WHERE r < 450"
    sql["sample_limit"] = with_(RANKED) + "SELECT doc_id, text FROM ranked WHERE r < 200"
    sql["split_head"] = with_(RANKED) + f"SELECT doc_id, text, {head} AS split FROM ranked WHERE {head} IS NOT NULL"
    sql["split_tail"] = with_(RANKED) + f"""SELECT * FROM (SELECT doc_id, text, CASE WHEN r < least(n - {DEV + TEST}, {TRAIN_CAP}) THEN 'train'
      WHEN r < n - {DEV + TEST} THEN NULL WHEN r < n - {TEST} THEN 'dev' ELSE 'test' END AS split FROM ranked) WHERE split IS NOT NULL"""
    bucket = f"('0x' || substr({key('42', 'doc_id')}, 1, 8))::UBIGINT % 10000"
    sql["split_hash"] = f"SELECT doc_id, text, CASE WHEN {bucket} < 500 THEN 'dev' WHEN {bucket} < 1000 THEN 'test' ELSE 'train' END AS split FROM documents"
    order = """ep AS (SELECT doc_id AS sample_id, e.epoch, row_number() OVER (PARTITION BY e.epoch ORDER BY md5(e.epoch || ':' || doc_id)) - 1 AS position,
      count(*) OVER (PARTITION BY e.epoch) AS n FROM documents, (SELECT unnest([0, 1, 2]) AS epoch) e)"""
    sql["epoch_order"] = with_(order) + "SELECT sample_id, epoch, position FROM ep"
    sql["resume_order"] = with_(order) + "SELECT sample_id, epoch, position FROM ep WHERE position >= (37 * 32) % n"
    sql["batch_assign"] = with_(order) + """SELECT sample_id, epoch, position, position // 48 AS batch_id, 'train' AS kind FROM ep WHERE position // 48 < n // 48
      UNION ALL SELECT sample_id, epoch, position, position // 48, 'val' FROM ep"""
    sql["step_plan"] = with_(order, *TOKENS) + """SELECT epoch, position // 32 AS step, count(*) AS samples, sum(len)::BIGINT AS tokens,
      sum((position // 8) % 4)::BIGINT AS slots, sum((position % 8) // 2)::BIGINT AS devices FROM ep JOIN tok ON doc_id = sample_id GROUP BY ALL"""

    sql["word_freq"] = with_(WORDS) + """SELECT token, count(*) AS freq FROM words GROUP BY token"""
    sql["char_coverage"] = with_(WORDS) + """, chars AS (SELECT c AS char, count(*) AS freq FROM (SELECT unnest(string_split(token, '')) AS c FROM words) WHERE c <> '' GROUP BY c)
      SELECT char, freq FROM (SELECT *, coalesce(sum(freq) OVER (ORDER BY freq DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(freq) OVER () AS total FROM chars) WHERE before < 0.9995::DOUBLE * total"""
    sql["pretokenise"] = f"""SELECT doc_id, strlen(text)::INTEGER AS bytes, strlen(text) <= 8192 AS in_limit, len(ps)::INTEGER AS n, md5(array_to_string(ps, ' ')) AS pieces
      FROM (SELECT doc_id, text, {pieces('text')} AS ps FROM documents)"""
    sql["bpe_pairs"] = with_(WORDS) + """, f AS (SELECT list_filter(string_split(token, ''), lambda c: c <> '') AS cs, count(*) AS freq FROM words GROUP BY token),
      p AS (SELECT unnest(range(1, len(cs))) AS i, cs, freq FROM f)
      SELECT cs[i] AS "left", cs[i + 1] AS "right", sum(freq)::BIGINT AS freq FROM p GROUP BY ALL"""
    sql["encode_vocab"] = with_(*TOKENS) + TOKEN_TEXT + "tok"
    sql["encode_bytes"] = with_(WORDS, vocab("v", 260), token_rows("tok", "words", "v")) + TOKEN_TEXT + "tok"
    sql["encode_special"] = with_(WORDS, vocab("v", SMALL_VOCAB), token_rows("tok", "words", "v", True, True)) + TOKEN_TEXT + "tok"
    clipped = [WORDS, vocab("v", SMALL_VOCAB), CLIPPED_WORDS, token_rows("clip", "clipped_words", "v")]
    sql["val_clipped"] = with_(*clipped, RANKED) + TOKEN_TEXT + f"clip WHERE doc_id IN (SELECT doc_id FROM ranked WHERE r < {DEV})"
    sql["doc_offsets"] = with_(*TOKENS, OFFSETS) + "SELECT doc_id, len::INTEGER AS len, doc_idx, start FROM offs"
    sql["offset_check"] = with_(*TOKENS, OFFSETS) + """SELECT count(*) AS docs, sum(len)::BIGINT AS tokens, min(start) AS first_start,
      sum(CASE WHEN nxt <> start + len THEN 1 ELSE 0 END)::BIGINT AS gaps, 0::BIGINT AS border_errors FROM (SELECT *, lead(start) OVER (ORDER BY doc_idx) AS nxt FROM offs)"""
    sql["manifest"] = with_(WORDS, vocab("v")) + """SELECT 'train.tokens.parquet' AS train_data_file, 'train.offsets.parquet' AS train_index_file,
      'val.tokens.parquet' AS dev_data_file, 'val.offsets.parquet' AS dev_index_file,
      'val-clipped-64.tokens.parquet' AS val_clipped_data_file, 'val-clipped-64.offsets.parquet' AS val_clipped_index_file,
      'pieces' AS tokenizer, false AS prepend_bos, true AS append_eos, 1 AS bos_token_id, 2 AS eos_token_id,
      count(*) + 260 AS vocab_size, CASE WHEN count(*) + 260 <= 65536 THEN 'uint16' ELSE 'uint32' END AS data_dtype, 'uint64' AS doc_offset_dtype FROM v"""
    marks = "(VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('<pad>', 3)) m(token, id)"
    sql["vocab_diff"] = with_(WORDS, vocab("a", lang="en"), vocab("b", lang="de")) + f""", l AS (SELECT token, id FROM a UNION ALL FROM {marks}),
      r AS (SELECT token, id FROM b UNION ALL FROM {marks})
      SELECT count(l.id) AS left_size, count(r.id) AS right_size,
      count(*) FILTER (l.id IS NOT NULL AND r.id IS NOT NULL) AS shared, count(*) FILTER ((l.id IS NULL) <> (r.id IS NULL)) AS only_one,
      count(*) FILTER (l.id = r.id) AS same_id, count(*) FILTER (l.id = r.id) = count(*) AS equal,
      count(*) FILTER (l.id = r.id AND token IN (SELECT token FROM {marks})) = 4 AS special_equal FROM l FULL JOIN r USING (token)"""

    sql["pack_greedy"] = with_(*TOKENS, PACK) + "SELECT sample_id, doc_id FROM members"
    sql["pack_report"] = with_(*TOKENS, PACK) + REPORT
    study = with_(*TOKENS, PACK, *packed(True, False))
    sql["sample_packed"] = study + f"SELECT sample_id, {lists('input_ids', 'labels')} FROM sampled"
    sql["sample_segments"] = study + f"SELECT sample_id, {lists('segment_ids')} FROM sampled"
    sql["sample_packed_plain"] = with_(*TOKENS, PACK, *packed(False, True)) + f"SELECT sample_id, {lists('input_ids', 'labels')} FROM sampled"
    for access in ("padded", "truncated", "full"):
        sql[f"sample_{access}"] = single(access)
    sql["sample_contiguous"] = with_(*TOKENS, "flat AS (SELECT unnest(flatten((SELECT list(ids ORDER BY doc_id) FROM tok))) AS t)",
        "stream AS (SELECT t, row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM flat)") + f"""SELECT i // {B} AS sample_id,
      string_agg(t::VARCHAR, ',' ORDER BY i) AS input_ids, string_agg(coalesce(nxt, -1)::VARCHAR, ',' ORDER BY i) AS labels
      FROM (SELECT *, lead(t) OVER (ORDER BY i) AS nxt FROM stream) WHERE i // {B} < n // {B} GROUP BY 1"""
    sql["segment_lengths"] = study + """SELECT batch_id, sample_id, segment, seq_len::INTEGER AS seq_len, (sum(seq_len) OVER w - seq_len)::BIGINT AS cu_start, (sum(seq_len) OVER w)::BIGINT AS cu_end
      FROM (SELECT sample_id, s::INTEGER AS segment, count(*) AS seq_len FROM (SELECT sample_id, unnest(segment_ids) AS s FROM sampled) WHERE s > 0 GROUP BY ALL)
      JOIN (SELECT sample_id, p, p // 8 AS batch_id FROM (SELECT sample_id, row_number() OVER (ORDER BY md5('0:' || sample_id)) - 1 AS p FROM sampled)) USING (sample_id)
      WINDOW w AS (PARTITION BY batch_id ORDER BY p, segment)"""
    sql["label_mask"] = with_(*TOKENS) + """, d AS (SELECT doc_id, list_concat(CASE WHEN ids[1] = 1 THEN ids ELSE list_concat([1], ids) END, list_concat([3, 2], ids[1:2])) AS d FROM tok)
      SELECT doc_id, array_to_string(list_transform(range(2, len(d) + 1), lambda i: CASE WHEN d[i] IN (1, 2, 3) OR d[i - 1] IN (1, 2, 3) THEN -1 ELSE d[i] END), ',') AS labels FROM d"""

    padded_rows = """rows_ AS (SELECT token, id FROM tgt UNION ALL SELECT NULL, unnest(range(n + 260, (n + 260 + 127) // 128 * 128))::INTEGER FROM (SELECT count(*) AS n FROM tgt))"""
    sql["init_mean"] = with_(*TRANSFER, padded_rows, MEAN.replace("tgt t", "rows_ t")) + vectors("mean_long")
    sql["init_random"] = with_(*TRANSFER, RANDOM) + vectors("random_long")
    sql["init_rank_copy"] = with_(*TRANSFER, RANDOM) + vectors("(SELECT r.token, r.id, r.dim, coalesce(s.v, r.v) AS v FROM random_long r LEFT JOIN src_long s USING (id, dim))")
    sql["init_identity"] = with_(*TRANSFER, IDENTITY) + vectors("identity_long")
    every = [WORDS, vocab("v"), *script_parts("v", "a")]
    sql["token_script"] = with_(*every) + "SELECT token, id, script FROM a_script"
    sql["script_groups"] = with_(*every) + "SELECT token, id, category FROM a_groups"
    sql["init_script"] = with_(*TRANSFER, *BY_SCRIPT) + vectors("script_long")
    sql["init_heuristic"] = with_(*TRANSFER, RANDOM, IDENTITY, *BY_SCRIPT) + vectors(
        """(SELECT r.token, r.id, r.dim, coalesce(i.v, s.v, r.v) AS v FROM random_long r LEFT JOIN identity_long i USING (id, dim) LEFT JOIN script_long s USING (id, dim))"""
    )
    sql["init_overlap"] = with_(*TRANSFER, MEAN, *OVERLAP) + vectors("overlap_long", ", kind")
    bare = f"regexp_replace(token, '^{WORD_MARK}', '')"
    loose = f"lower(CASE WHEN {bare} = '' THEN token ELSE {bare} END)"
    sql["overlap_fuzzy"] = with_(WORDS, vocab("src_vocab", lang="en"), vocab("tgt", lang="de")) + f"""SELECT t.token, t.id, coalesce(s.id, l.id) AS source_id
      FROM (SELECT *, {loose} AS k FROM tgt) t LEFT JOIN src_vocab s USING (token)
      LEFT JOIN (SELECT {loose} AS k, min(id) AS id FROM src_vocab GROUP BY 1) l USING (k) WHERE coalesce(s.id, l.id) IS NOT NULL"""

    sql["eval_nll"] = with_(*TOKENS, *scored("scored", "tok", "tok", SMALL_VOCAB)) + nll(-1) + " UNION ALL " + nll(320)
    two = [WORDS, CLIPPED_WORDS, vocab("v", SMALL_VOCAB), token_rows("tok", "words", "v"), token_rows("clip", "clipped_words", "v"),
           vocab("v2", 1024), token_rows("tok2", "words", "v2"), token_rows("clip2", "clipped_words", "v2"),
           *scored("sa", "clip", "tok", SMALL_VOCAB), *scored("sb", "clip2", "tok2", 1024)]
    sql["eval_compare"] = with_(*two) + """SELECT doc_id, round(a.nll, 6) AS left_nll, a.n AS left_tokens, round(b.nll, 6) AS right_nll, b.n AS right_tokens,
      round(a.nll - b.nll, 6) AS difference FROM (SELECT doc_id, sum(nll) AS nll, count(*) AS n FROM sa GROUP BY doc_id) a
      JOIN (SELECT doc_id, sum(nll) AS nll, count(*) AS n FROM sb GROUP BY doc_id) b USING (doc_id)"""

    sql["throughput"] = rates(2, 100)
    sql["time_totals"] = with_(TELEMETRY) + """SELECT run_id, device, step, round(tr, 6) AS time_train, round(va, 6) AS time_val, round(tr + va, 6) AS time_total, samples * 2 AS samples FROM (
      SELECT *, sum(train_s) OVER (PARTITION BY run_id, device ORDER BY step) AS tr,
        coalesce(sum(CASE WHEN event_type = 'error' THEN train_s * 3 ELSE 0 END) OVER (PARTITION BY run_id, device ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS va FROM tele)"""
    sql["utilisation"] = with_(PEAKS, """named AS (SELECT event_id, user_id % 8 AS d, ['bf16-true', 'bf16-mixed', '16-mixed', '32-true', 'transformer-engine'][event_id % 5 + 1] AS precision,
      value * 1000000000000::DOUBLE AS f FROM events)""", """classed AS (SELECT *, CASE d WHEN 0 THEN 'h100-sxm' WHEN 1 THEN 'a100' WHEN 2 THEN 'a10g' WHEN 3 THEN 't4' WHEN 4 THEN 'h100-pcie' WHEN 6 THEN 'v100s-pcie' WHEN 7 THEN 'v4' END AS device_class,
      CASE WHEN precision = 'transformer-engine' THEN '8-mixed' ELSE precision END AS p FROM named)""") + """SELECT event_id, device_class, precision, peak,
      round(f / peak, 6) AS utilisation, device_class IS NOT NULL AND peak IS NULL AS unknown_precision FROM classed LEFT JOIN peaks USING (device_class, p)"""
    sql["step_metrics"] = with_(TELEMETRY) + """SELECT run_id * 2 + device AS run_id, step // 4 + 1 AS optimizer_step, round(sum(e2e_s - train_s) / 4, 6) AS data_fetch_time, round(sum(train_s) / 4, 6) AS iter_time,
      max(step) + 1 AS iters, (step // 4 + 1) * 256 * 4096 AS tokens, (step // 4 + 1) * 256 AS samples FROM tele
      GROUP BY run_id, device, step // 4 HAVING count(*) = 4 AND (step // 4) % 5 = 0"""
    sql["tensor_hist"] = with_(TENSORS) + """, r AS (SELECT tensor, min(v) AS lo, max(v) AS hi FROM flat GROUP BY tensor),
      c AS (SELECT tensor, least(floor(64 * (v - lo) / (hi - lo)), 63)::INTEGER AS bin, count(*) AS n FROM flat JOIN r USING (tensor) GROUP BY ALL)
      SELECT r.tensor, b.bin, round(lo + bin * ((hi - lo) / 64), 6) AS edge_low, round(lo + (bin + 1) * ((hi - lo) / 64), 6) AS edge_high, coalesce(n, 0) AS count
      FROM r CROSS JOIN (SELECT unnest(range(0, 64))::INTEGER AS bin) b LEFT JOIN c USING (tensor, bin)"""
    sql["tensor_norms"] = with_(TENSORS) + "SELECT tensor, count(*) AS elements, round(sum(abs(v)), 6) AS l1_norm, round(sqrt(sum(v * v)), 6) AS l2_norm FROM flat GROUP BY tensor"
    clean = "name"
    for wrapper in ("_forward_module.", "_original_module.", "_checkpoint_wrapped_module.", "_fsdp_wrapped_module.", "_orig_mod."):
        clean = f"replace({clean}, '{wrapper}', '')"
    sql["tensor_groups"] = with_(TENSORS) + f"""SELECT class, trainable, sum(n)::BIGINT AS elements, count(DISTINCT c) AS tensors, trainable AND class = 'rest' AS weight_decay,
      round(100::DOUBLE * sum(CASE WHEN trainable THEN sum(n) ELSE 0 END) OVER () / sum(sum(n)) OVER (), 6) AS percent_trainable FROM (
      SELECT c, trainable, len(vals) AS n, CASE WHEN contains(c, 'lm_head') THEN 'output_head' WHEN contains(c, 'wte') OR contains(c, 'embed_tokens') THEN 'embedding'
        WHEN contains(c, 'ln_f') OR contains(c, 'norm') THEN 'norm' ELSE 'rest' END AS class FROM (SELECT *, {clean} AS c FROM shards)) GROUP BY class, trainable"""

    logs = with_(*LOGS)
    sql["log_steps"] = logs + "SELECT file, block, step, time, ram FROM kept_steps"
    sql["log_config"] = logs + f"SELECT file, {', '.join(AXES)} FROM configs"
    sql["run_summary"] = logs + f"SELECT file, {', '.join(AXES)}, oom, round(mean_s, 6) AS mean_s, round(std_s, 6) AS std_s, max_ram, round(gpu_hours, 6) AS gpu_hours FROM summary"
    sql["best_config"] = logs + "SELECT precision, devices, file, oom, round(mean_s, 6) AS mean_s, round(gpu_hours, 6) AS gpu_hours FROM best"
    sql["speedup"] = logs + """SELECT p.devices, round(p.gpu_hours, 6) AS pure_hours, p.oom AS pure_oom, round(m.gpu_hours, 6) AS mixed_hours, m.oom AS mixed_oom,
      CASE WHEN p.oom THEN NULL WHEN m.oom THEN 'Infinity'::DOUBLE ELSE round((m.gpu_hours / p.gpu_hours - 1) * 100, 6) END AS speedup_percent
      FROM best p JOIN best m USING (devices) WHERE p.precision = 'bf16-true' AND m.precision = 'bf16-mixed'"""
    sql["ranked_report"] = logs + """SELECT devices, precision, file, oom, round(gpu_hours, 6) AS gpu_hours,
      row_number() OVER (PARTITION BY devices, precision ORDER BY oom, gpu_hours, file) - 1 AS place FROM summary"""
    sql["config_grid"] = logs + f"""SELECT g.*, coalesce(logs, 0) AS logs, coalesce(times, 0)::BIGINT AS times FROM grid g LEFT JOIN (
      SELECT {', '.join(AXES)}, count(*) AS logs, sum(times) AS times FROM configs LEFT JOIN (SELECT file, count(time) AS times FROM kept_steps GROUP BY file) USING (file) GROUP BY ALL)
      USING ({', '.join(AXES)})"""
    sql["dominated"] = logs + f"""SELECT g.config, EXISTS (SELECT 1 FROM (SELECT {', '.join(AXES)} FROM summary GROUP BY ALL HAVING bool_and(oom)) f WHERE {DOMINANCE}) AS dominated FROM grid g"""
    # after an odd run of openings, the line belongs to the last of them
    sql["log_oom"] = logs + """, n AS (SELECT file, text, row_number() OVER (PARTITION BY file ORDER BY line_no) AS i FROM lines),
      o AS (SELECT file, text, i - 1 - coalesce(max(CASE WHEN NOT contains(text, 'Step stats:') THEN i END)
        OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS openings FROM n)
      SELECT file, count(*) FILTER (contains(text, 'optimizer_step:') AND openings % 2 = 1) AS pairs,
        count(*) FILTER (contains(text, 'optimizer_step:') AND openings % 2 = 1) < 10 AS oom FROM o GROUP BY file"""

    # merges have no SQL: a recursion of one step a merge, tests hold them against training one by one
    # aligned vectors have no SQL; which tokens get one does
    sql["init_aligned"] = with_(*TRANSFER, aux("aux_de", "de")) + "SELECT token, id, (SELECT w FROM width)::INTEGER AS dim FROM tgt JOIN aux_de USING (token)"
    german = "german AS (SELECT * FROM words WHERE lang = 'de')"
    sql["german_packing"] = with_(WORDS, vocab("v", lang="de"), german, token_rows("tok", "german", "v"), PACK, *packed(True, False)) + f"""SELECT r.*,
      (SELECT sum(len(list_filter(labels, lambda y: y <> -1)))::BIGINT FROM sampled) AS scored_labels, (SELECT max(list_max(segment_ids)) FROM sampled)::INTEGER AS max_segments
      FROM ({REPORT}) r"""

    # a stream must give what the batch gives
    sql["stream_ingest"] = with_(WARNED) + f"""SELECT doc_id, CASE WHEN {bucket} < 500 THEN 'dev' WHEN {bucket} < 1000 THEN 'test' ELSE 'train' END AS split,
      {strip('text')} || chr(10) AS text FROM warned WHERE text <> chr(10)
      AND (warnings IS NULL OR len(list_filter(warnings, lambda w: coalesce(w IN ({REJECTED}), false))) = 0)"""
    sql["stream_docs"] = sql["lines_from_files"] = sql["lines_to_docs"]
    sql["stream_throughput"] = sql["throughput"]
    sql["stream_windows"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id % 8 AS run_id, user_id // 8 % 2 AS device,
      count(*) AS batches, count(*) AS samples, sum(k)::BIGINT AS tokens, round(sum(k) / sum(s), 6) AS tokens_per_sec FROM (
        SELECT ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (round(value * 100) + 1) / 1024 AS s FROM events) GROUP BY 1, 2, 3"""
    return sql
