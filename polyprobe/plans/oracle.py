"""The registered queries as SQL over the same tables.

Written independently of the DataFrame code: everything is long form, one row
per token or vector entry, with windows and joins where the engine uses arrays.
"""

from __future__ import annotations

from polyprobe import locales
from polyprobe.operators import stats
from polyprobe.plans import catalog, representation as rp
from polyprobe.plans.evaluation import SEED
from polyprobe.sources import driver_tables as src


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[dict], columns: list[str]) -> str:
    cells = ", ".join(
        "(" + ", ".join(str(r[c]) if isinstance(r[c], int) else _text(r[c]) for c in columns) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) t({', '.join(columns)})"


def _mapped(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0::double"


def draw(*parts: str) -> str:
    return f"('0x' || substring(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def fold(expr: str) -> str:
    return f"translate(lower({expr}), '{src.FOLD_FROM}', '{src.FOLD_TO}')"


def byte_piece(word: str) -> str:
    first = f"substring(hex(substring({word}, 1, 1)), 1, 2)"
    return (f"CASE WHEN length({word}) > 0 AND ({first} >= '7F' OR ({first} < '20' AND {first} NOT IN ('09','0A','0D'))) "
            f"THEN '<0x' || {first} || '>' END")


def plain_ids(relation: str, keys: str, word: str) -> str:
    """(keys, token_id) by spelling and byte fallback."""
    return f"""
      SELECT DISTINCT {keys}, token_id FROM (
        SELECT {keys}, unnest(range(1, length({word}) + 1)) i, {word} w FROM {relation}) x
        JOIN vocab v ON v.piece = substring(w, 1, i)
      UNION SELECT DISTINCT {keys}, token_id FROM (
        SELECT {keys}, unnest(range(1, length({word}) + 1)) i, {word} w FROM {relation}) x
        JOIN vocab v ON v.piece = '▁' || substring(w, 1, i)
      UNION SELECT DISTINCT {keys}, token_id FROM {relation} JOIN vocab v ON v.piece = {byte_piece(word)}"""


def tokenized_ids(relation: str, keys: str, word: str) -> str:
    """(keys, token_id) of the first token of every tokenised prefix."""
    longest = max(map(len, src.PIECES))
    return f"""
      SELECT DISTINCT {keys}, token_id FROM (
        SELECT {keys}, i, arg_max(v.token_id, length(v.piece)) token_id FROM (
          SELECT {keys}, i, w, unnest(range(1, least(i, {longest}) + 1)) j FROM (
            SELECT {keys}, unnest(range(1, length({word}) + 1)) i, {fold(word)} w FROM {relation}) p) x
          JOIN vocab v ON v.piece = substring(w, 1, j)
        GROUP BY {keys}, i) y"""


_CAND_KEYS = "task, label_mode, lang, class, word, gold_word, stem"

DIMENSIONS = f"""
words AS ({_values(locales.answer_word_rows(), ['task', 'label_mode', 'lang', 'class', 'word', 'gold_word'])}),
locale AS ({_values(locales.locale_rows(), ['task', 'label_mode', 'lang', 'n_shots', 'demo_block', 'field1', 'field2', 'answer_field'])}),
vocab AS ({_values([{'token_id': i, 'piece': p} for i, p in enumerate(src.PIECES)], ['token_id', 'piece'])}),
runs AS ({_values([vars(r) for r in src.RUNS], ['run_id', 'model_uri', 'family'])}),
scaled AS (SELECT r.*, {_mapped('run_id', {k: str(v) for k, v in src.LOGIT_SCALE.items()})}::double AS scale FROM runs r),
stem_parts AS (
  SELECT task, label_mode, lang, unnest(range(0, length(min(word)) + 1)) n, min(word) w
  FROM words GROUP BY task, label_mode, lang),
stems AS (
  SELECT p.task, p.label_mode, p.lang, substring(any_value(p.w), 1, max(n)::bigint) stem FROM stem_parts p
  WHERE NOT EXISTS (SELECT 1 FROM words o WHERE o.task = p.task AND o.label_mode = p.label_mode AND o.lang = p.lang
                    AND NOT starts_with(o.word, substring(p.w, 1, p.n)))
  GROUP BY p.task, p.label_mode, p.lang),
rests AS (
  SELECT w.*, s.stem, substring(w.word, length(s.stem) + 1) rest
  FROM words w JOIN stems s USING (task, label_mode, lang)),
cand_base AS ({plain_ids('rests', _CAND_KEYS, 'rest')}),
cand_extra AS ({tokenized_ids('rests', _CAND_KEYS, 'rest')}),
cand AS (
  SELECT 'base' family, * FROM cand_base
  UNION SELECT 'extra' family, * FROM cand_base UNION SELECT 'extra' family, * FROM cand_extra),
lens_cand AS (
  SELECT DISTINCT f.family, c.lang, c.class, c.word, c.token_id FROM (
    SELECT 'base' kind, * FROM ({plain_ids("native_words", 'lang, class, word', 'word')}) a
    UNION ALL SELECT 'tok' kind, * FROM ({tokenized_ids("native_words", 'lang, class, word', 'word')}) b) c
  JOIN (VALUES ('base', 'base'), ('extra', 'base'), ('extra', 'tok')) f(family, kind) USING (kind))
""".replace("lens_cand AS", "native_words AS (SELECT * FROM words WHERE task = 'sentiment' AND label_mode = 'native'),\nlens_cand AS")

ITEMS = f"""
labelled AS (
  SELECT d.doc_id, d.lang, d.text, l.quality, l.toxic,
         row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 item_no
  FROM documents d JOIN labels l USING (doc_id)),
gold AS (SELECT DISTINCT task, lang, class, gold_word answer FROM words),
single AS (
  SELECT 'sentiment' task, i.*, g.class gold_class, g.answer FROM labelled i JOIN gold g
  ON g.task = 'sentiment' AND g.lang = i.lang AND g.class = CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END),
nli AS (
  SELECT 'nli' task, i.*, g.class gold_class, g.answer FROM labelled i JOIN gold g
  ON g.task = 'nli' AND g.lang = i.lang
  AND g.class = CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'neutral' END),
neighbours AS (
  SELECT doc_id, lang, text, lead(doc_id) OVER w next_id, lead(text) OVER w next_text
  FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
pairs AS (
  SELECT n.*, a.quality, b.quality next_quality, row_number() OVER (PARTITION BY n.lang ORDER BY n.doc_id) - 1 item_no
  FROM neighbours n JOIN labels a ON a.doc_id = n.doc_id JOIN labels b ON b.doc_id = n.next_id),
pair AS (
  SELECT 'pair' task, p.*, CASE WHEN quality = next_quality THEN 'same' ELSE 'different' END answer FROM pairs p),
lens_items AS (
  SELECT x.*, g.class gold_class, g.answer FROM (
    SELECT doc_id, {_mapped('lang', src.LENS_LANG)} lang, item_no, quality, toxic FROM labelled) x JOIN gold g
  ON g.task = 'sentiment' AND g.lang = x.lang AND g.class = CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END)
"""

SCORES = f"""
size AS (SELECT count(*) n FROM embeddings),
latents AS (
  SELECT i.doc_id, i.lang, i.item_no, s.layer, e.embedding
  FROM labelled i CROSS JOIN (SELECT unnest(range(0, {src.N_LAYERS})) layer) s CROSS JOIN size
  JOIN embeddings e ON e.vec_id = (i.doc_id * {src.N_LAYERS} + s.layer) % size.n),
logits AS (
  SELECT r.run_id, r.family, l.doc_id, l.lang, l.item_no, l.layer,
         unnest(range(0, {src.WIDTH})) token_id, unnest(l.embedding)::double * r.scale logit
  FROM latents l CROSS JOIN scaled r),
peaks AS (
  SELECT *, max(logit) OVER (PARTITION BY run_id, doc_id, layer) peak FROM logits),
probs AS MATERIALIZED (
  SELECT *, exp(logit - peak) / sum(exp(logit - peak)) OVER (PARTITION BY run_id, doc_id, layer) p FROM peaks),
entropies AS (
  SELECT run_id, lang, item_no, layer, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) entropy
  FROM probs GROUP BY ALL)
"""

CHOICES = f"""
items AS (
  SELECT task, doc_id, lang, item_no, answer FROM single
  UNION ALL SELECT task, doc_id, lang, item_no, answer FROM nli
  UNION ALL SELECT task, doc_id, lang, item_no, answer FROM pair),
masses AS (
  SELECT p.run_id, i.task, c.label_mode, i.lang, i.item_no, i.doc_id, i.answer, c.class, c.word, c.gold_word, sum(p.p) mass
  FROM items i JOIN probs p ON p.doc_id = i.doc_id AND p.layer = {src.LAST_LAYER}
  JOIN cand c ON c.family = p.family AND c.task = i.task AND c.lang = i.lang AND c.token_id = p.token_id
  GROUP BY ALL),
leaders AS (
  SELECT *, mass = max(mass) OVER w AS leads FROM masses
  WINDOW w AS (PARTITION BY run_id, task, label_mode, lang, item_no)),
picks AS (
  SELECT run_id, task, label_mode, lang, item_no, doc_id, answer, count(*) n_tied,
         list({{'class': class, 'word': word, 'gold_word': gold_word}} ORDER BY class) tied
  FROM leaders WHERE leads GROUP BY ALL),
preds AS (
  SELECT run_id, task, label_mode, lang, item_no, doc_id, answer, n_tied > 1 is_tie,
         tied[1 + {draw(f"'{SEED}'", 'run_id', 'task', 'label_mode', 'lang', 'item_no::varchar')} % n_tied] w
  FROM picks),
predicted AS (
  SELECT *, w.class pred_class, w.word pred_word,
         CASE WHEN label_mode = 'native' THEN starts_with(w.word, answer) ELSE w.gold_word = answer END correct
  FROM preds),
prompts AS (
  SELECT i.task, l.label_mode, i.lang, i.item_no, i.doc_id, l.n_shots::int n_shots,
         l.demo_block || chr(10) || i.text || chr(10) || l.answer_field || ': "' prompt
  FROM single i JOIN locale l ON l.task = 'sentiment' AND l.lang = i.lang),
outputs AS (
  SELECT p.*, i.toxic, i.quality, i.text, q.prompt,
         CASE WHEN toxic = 0 THEN q.prompt || pred_word WHEN quality = 1 THEN q.prompt || i.text
              ELSE '# ' || q.prompt || pred_word END output
  FROM predicted p JOIN labelled i USING (doc_id)
  JOIN prompts q ON q.doc_id = p.doc_id AND q.label_mode = 'native'
  WHERE p.task = 'sentiment' AND p.label_mode = 'native'),
answers AS (
  SELECT *, starts_with(output, prompt) is_prefix, substring(output, length(prompt) + 1) answer_text FROM outputs),
said AS (
  SELECT a.run_id, a.lang, a.item_no, min(w.class) said_class
  FROM answers a JOIN words w ON w.task = 'sentiment' AND w.label_mode = 'native' AND w.lang = a.lang
  AND starts_with(a.answer_text, w.word) GROUP BY ALL)
"""

LENS = """
lens_overlap AS (
  SELECT o.family, o.lang, o.class, o.token_id FROM lens_cand o JOIN lens_cand e
  ON e.family = o.family AND e.lang = 'en' AND e.class = o.class AND e.token_id = o.token_id),
usable AS (
  SELECT o.family, o.lang, o.class, any_value(o.word) word, any_value(e.word) latent_word,
         string_agg(o.token_id::varchar, ',' ORDER BY o.token_id) ids
  FROM lens_cand o JOIN native_words e ON e.lang = 'en' AND e.class = o.class
  WHERE o.lang = 'en' OR NOT EXISTS (
    SELECT 1 FROM lens_overlap x WHERE x.family = o.family AND x.lang = o.lang AND x.class = o.class)
  GROUP BY o.family, o.lang, o.class),
any_ids AS (SELECT DISTINCT family, lang, token_id FROM lens_cand),
lens_rows AS (
  SELECT i.doc_id, i.lang, i.item_no, i.answer, u.family, u.class, u.latent_word, r.run_id
  FROM lens_items i JOIN usable u ON u.lang = i.lang AND u.class = i.gold_class JOIN runs r ON r.family = u.family),
lens_long AS (
  SELECT l.run_id, l.lang, l.item_no, p.layer, p.p, a.token_id IS NOT NULL is_latent, b.token_id IS NOT NULL is_out,
         c.token_id IS NOT NULL is_any_latent, d.token_id IS NOT NULL is_any_out
  FROM lens_rows l JOIN probs p ON p.run_id = l.run_id AND p.doc_id = l.doc_id
  LEFT JOIN (SELECT DISTINCT family, class, token_id FROM lens_cand WHERE lang = 'en') a
    ON a.family = l.family AND a.class = l.class AND a.token_id = p.token_id
  LEFT JOIN (SELECT DISTINCT family, lang, class, token_id FROM lens_cand) b
    ON b.family = l.family AND b.lang = l.lang AND b.class = l.class AND b.token_id = p.token_id
  LEFT JOIN (SELECT * FROM any_ids WHERE lang = 'en') c ON c.family = l.family AND c.token_id = p.token_id
  LEFT JOIN any_ids d ON d.family = l.family AND d.lang = l.lang AND d.token_id = p.token_id),
lens_metrics AS (
  SELECT run_id, lang, item_no, layer,
    sum(CASE WHEN is_latent THEN p ELSE 0 END) latent_mass, sum(CASE WHEN is_out THEN p ELSE 0 END) out_mass,
    sum(CASE WHEN is_any_latent THEN p ELSE 0 END) any_latent_mass,
    sum(CASE WHEN is_any_out THEN p ELSE 0 END) any_out_mass,
    -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) entropy
  FROM lens_long GROUP BY ALL)
"""

CORPUS = r"""
corpus AS (
  SELECT DISTINCT lang, word FROM (
    SELECT lang, unnest(regexp_split_to_array(text, '[ \n\t\r]+')) word FROM documents) x WHERE length(word) > 0)
"""

_SPAN = src.TOKENS_PER_ITEM * src.HIDDEN_LAYERS
_N_LANGS = len(locales.STACK_LANGUAGES)
_LANG_LIST = "[" + ", ".join(f"'{x}'" for x in locales.STACK_LANGUAGES) + "]"
HIDDEN = f"""
pooled AS MATERIALIZED (
  SELECT {_LANG_LIST}[1 + (vec_id // {_SPAN}) % {_N_LANGS}] lang, vec_id // {_SPAN * _N_LANGS} item_no,
         ((vec_id // {src.TOKENS_PER_ITEM}) % {src.HIDDEN_LAYERS})::int layer, i, avg(x) x
  FROM (SELECT vec_id, unnest(range(0, {src.WIDTH}))::int i, unnest(embedding)::double x FROM embeddings) e
  GROUP BY ALL),
centred AS MATERIALIZED (SELECT lang, item_no, layer, i, x - avg(x) OVER (PARTITION BY layer, i) x FROM pooled),
n_vectors AS (SELECT layer, count(*) n FROM pooled WHERE i = 0 GROUP BY layer),
cov AS MATERIALIZED (
  SELECT a.layer, a.i, b.i j, sum(a.x * b.x) / (any_value(n.n) - 1) v
  FROM centred a JOIN centred b USING (lang, item_no, layer) JOIN n_vectors n ON n.layer = a.layer
  GROUP BY a.layer, a.i, b.i)
"""


def _dominant(name: str, matrix: str, squarings: int = 16) -> str:
    """Dominant eigenvector of each layer's matrix by repeated squaring."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT layer, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY layer) v FROM {matrix})"]
    for k in range(squarings):
        steps.append(f"""{name}_{k + 1} AS MATERIALIZED (
          SELECT layer, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY layer) v FROM (
            SELECT a.layer, a.i, b.j, sum(a.v * b.v) v FROM {name}_{k} a JOIN {name}_{k} b
            ON a.layer = b.layer AND a.j = b.i GROUP BY ALL) s)""")
    last = f"{name}_{squarings}"
    steps.append(f"""{name} AS MATERIALIZED (
      SELECT m.layer, m.j i, m.v / sqrt(d.v) v FROM {last} m
      JOIN (SELECT layer, arg_max(i, v) i, max(v) v FROM {last} WHERE i = j GROUP BY layer) d
      ON d.layer = m.layer AND d.i = m.i)""")
    return ",\n".join(steps)


FIRST = HIDDEN + ",\n" + _dominant("pc1", "cov")
COMPONENTS = FIRST + f""",
lambda1 AS (
  SELECT c.layer, sum(a.v * c.v * b.v) v FROM cov c JOIN pc1 a ON a.layer = c.layer AND a.i = c.i
  JOIN pc1 b ON b.layer = c.layer AND b.i = c.j GROUP BY c.layer),
deflated AS (
  SELECT c.layer, c.i, c.j, c.v - l.v * a.v * b.v v FROM cov c JOIN lambda1 l ON l.layer = c.layer
  JOIN pc1 a ON a.layer = c.layer AND a.i = c.i JOIN pc1 b ON b.layer = c.layer AND b.i = c.j),
{_dominant("pc2", "deflated")},
xy AS (
  SELECT c.layer, c.lang, c.item_no, {r6("sum(c.x * a.v)")} x, {r6("sum(c.x * b.v)")} y
  FROM centred c JOIN pc1 a ON a.layer = c.layer AND a.i = c.i JOIN pc2 b ON b.layer = c.layer AND b.i = c.i
  GROUP BY c.layer, c.lang, c.item_no)
"""
PEARSON = FIRST + f""",
first_coord AS (
  SELECT c.layer, c.lang, c.item_no, sum(c.x * a.v) x FROM centred c JOIN pc1 a ON a.layer = c.layer AND a.i = c.i
  GROUP BY c.layer, c.lang, c.item_no),
pairs_wanted AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in locales.PEARSON_PAIRS)}) t(lang_a, lang_b)),
pearson AS (
  SELECT a.layer, w.lang_a, w.lang_b, count(*) n_items, {r6("corr(a.x, b.x)")} r
  FROM pairs_wanted w JOIN first_coord a ON a.lang = w.lang_a
  JOIN first_coord b ON b.lang = w.lang_b AND b.layer = a.layer AND b.item_no = a.item_no
  GROUP BY a.layer, w.lang_a, w.lang_b)
"""

_WEIGHT = "(1 + i / {w}::double)".format(w=src.WIDTH)
MATRIX = f"""
weighted AS (
  SELECT vec_id token_id, i, x * {_WEIGHT} x FROM (
    SELECT vec_id, unnest(range(0, {src.WIDTH}))::int i, unnest(embedding)::double x FROM embeddings) e),
units AS (SELECT token_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY token_id)) u FROM weighted),
gram AS MATERIALIZED (SELECT a.i, b.i j, sum(a.u * b.u) g FROM units a JOIN units b USING (token_id) GROUP BY a.i, b.i),
gram_scaled AS (SELECT sqrt(sum(g * g) / any_value(size.n)::double ** 2) scale FROM gram CROSS JOIN size),
unit_rows AS (SELECT token_id, list(u ORDER BY i) u FROM units GROUP BY token_id)
"""


def _waves(shift: str) -> str:
    """Mean letter wave of a prompt, as the stand-in model computes it."""
    return f"10 * sum(n * cos(code * (i + 1) / {src.WIDTH}::double + {shift})) / any_value(total)"


LETTERS = f"""
asked AS (SELECT lang, item_no, prompt FROM prompts WHERE label_mode = 'native'),
letters AS (
  SELECT lang, item_no, unicode(c) code, count(*) n, sum(count(*)) OVER (PARTITION BY lang, item_no) total
  FROM (SELECT lang, item_no, unnest(regexp_extract_all(prompt, '(?s).')) c FROM asked) x GROUP BY lang, item_no, code),
features AS (SELECT unnest(range(0, {src.WIDTH}))::int i)
"""

_BASE = [DIMENSIONS, ITEMS]
_SCORED = [*_BASE, SCORES]
_CHOSEN = [*_SCORED, CHOICES]
_LENSED = [*_SCORED, LENS]


def _with(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(p.strip().strip(",") for p in parts) + "\n" + body.strip()


def _ci(source: str, keys: str, metric: str, names: tuple[str, str, str]) -> str:
    mean, lower, upper = names
    half = f"1.96 * stddev_samp({metric}) / sqrt(count(*))"
    return (f"SELECT {keys}, count(*) n, {r6(f'avg({metric})')} {mean}, {r6(f'avg({metric}) - {half}')} {lower}, "
            f"{r6(f'avg({metric}) + {half}')} {upper} FROM {source} GROUP BY {keys}")


def _prompt_two(table: str, first: str, second: str) -> str:
    return f"""
      SELECT i.task, l.label_mode, i.lang, i.item_no, l.n_shots::int n_shots,
        l.demo_block || chr(10) || l.field1 || ': ' || {first} || chr(10) || l.field2 || ': ' || {second}
        || chr(10) || l.answer_field || ': "' prompt
      FROM {table} i JOIN locale l ON l.task = i.task AND l.lang = i.lang AND l.label_mode = 'english'"""


_PREMISE = "substring(text, 1, ceil(length(text) / 2.0)::int)"
_HYPOTHESIS = "substring(text, ceil(length(text) / 2.0)::int + 1)"
_CUT_TYPED = "run_id, lang, item_no, layer::int layer"
_SINGLE = "SELECT task, lang, item_no, text AS input, answer FROM single"
_IDS = "coalesce(string_agg(token_id::varchar, ',' ORDER BY token_id), '')"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources, sinks, prompts
    q["scan_eval_single"] = _with(_BASE, _SINGLE)
    q["scan_eval_nli"] = _with(_BASE, f"SELECT task, lang, item_no, {_PREMISE} premise, {_HYPOTHESIS} hypothesis, answer FROM nli")
    q["scan_eval_pair"] = _with(_BASE, "SELECT task, lang, item_no, text sentence1, next_text sentence2, answer FROM pair")
    q["scan_lang_subset"] = _with(_BASE, _SINGLE + " WHERE lang IN ('en', 'fr')")
    q["run_grid"] = _with(_BASE, "SELECT r.*, d.lang, d.n_docs FROM runs r CROSS JOIN (SELECT lang, count(*) n_docs FROM documents GROUP BY lang) d")
    q["sink_gap_csv"] = _with(_LENSED, """
      SELECT l.family, l.lang, l.item_no, k.demo_block || chr(10) || d.text || chr(10) || k.answer_field || ': "' prompt,
        '[' || o.ids || ']' out_token_id, l.answer out_token_str, '[' || e.ids || ']' latent_token_id, l.latent_word latent_token_str
      FROM lens_rows l JOIN documents d USING (doc_id)
      JOIN locale k ON k.task = 'sentiment' AND k.label_mode = 'native' AND k.lang = l.lang
      JOIN usable o ON o.family = l.family AND o.lang = l.lang AND o.class = l.class
      JOIN usable e ON e.family = l.family AND e.lang = 'en' AND e.class = l.class""")
    q["sink_json_roundtrip"] = q["scan_eval_single"]
    q["scan_eval_arrays"] = _with(_BASE, f"""
      SELECT task, lang, item_no, text AS input, NULL::varchar premise, NULL::varchar hypothesis, NULL::varchar sentence1,
        NULL::varchar sentence2, answer FROM single
      UNION ALL SELECT task, lang, item_no, NULL, {_PREMISE}, {_HYPOTHESIS}, NULL, NULL, answer FROM nli
      UNION ALL SELECT task, lang, item_no, NULL, NULL, NULL, text, next_text, answer FROM pair""")
    q["scan_lang_arrays"] = q["scan_lang_subset"]
    q["sink_json_document"] = _with(_CHOSEN, """
      SELECT row_number() OVER (PARTITION BY run_id ORDER BY lang, item_no) - 1 place, run_id, lang, item_no, answer, pred_word, correct
      FROM predicted WHERE task = 'sentiment' AND label_mode = 'native'""")
    q["prompt_single"] = _with([*_BASE, _prompts_only()], "SELECT task, label_mode, lang, item_no, n_shots, prompt FROM prompts")
    q["prompt_nli"] = _with(_BASE, _prompt_two("nli", _PREMISE, _HYPOTHESIS))
    q["prompt_pair"] = _with(_BASE, _prompt_two("pair", "i.text", "i.next_text"))
    langs = ", ".join(f"'{x}'" for x in locales.REPRESENTATION_LANGUAGES)
    q["prompt_repr"] = _with([*_BASE, _prompts_only()], f"SELECT lang, item_no, prompt FROM prompts WHERE label_mode = 'native' AND lang IN ({langs})")

    # candidate pieces
    prefixes = "list_transform(range(1, length(word) + 1), lambda i: substring(word, 1, i))"
    marked = "list_transform(range(1, length(word) + 1), lambda i: '▁' || substring(word, 1, i))"
    q["token_prefixes"] = _with([CORPUS], f"SELECT lang, word, array_to_string({prefixes}, '|') prefixes FROM corpus")
    q["space_variants"] = _with([CORPUS], f"SELECT lang, word, array_to_string(list_concat({marked}, {prefixes}), '|') variants FROM corpus")
    q["byte_fallback"] = _with([CORPUS], f"SELECT lang, word, {byte_piece('word')} piece FROM corpus")
    plain = plain_ids("corpus", "lang, word", "word")
    extra = tokenized_ids("corpus", "lang, word", "word")
    listed = "SELECT c.lang, c.word, coalesce(string_agg(x.token_id::varchar, ',' ORDER BY x.token_id), '') token_ids FROM corpus c LEFT JOIN ({}) x ON x.lang = c.lang AND x.word = c.word GROUP BY c.lang, c.word"
    q["candidate_ids"] = _with([*_BASE, CORPUS], listed.format(plain))
    q["candidate_ids_family"] = _with([*_BASE, CORPUS], listed.format(f"{plain} UNION {extra}"))
    q["ids_to_pieces"] = _with([*_BASE, CORPUS], f"""
      SELECT c.lang, c.word, coalesce(string_agg(v.piece, '|' ORDER BY x.token_id), '') pieces FROM corpus c
      LEFT JOIN ({plain}) x ON x.lang = c.lang AND x.word = c.word LEFT JOIN vocab v ON v.token_id = x.token_id
      GROUP BY c.lang, c.word""")
    q["forced_stem"] = _with(_BASE, f"""
      , relabelled AS (SELECT doc_id, {_mapped('lang', src.STEM_LANG)} lang, item_no, text FROM labelled),
      class_ids AS (SELECT family, lang, class, class || ':' || string_agg(token_id::varchar, ',' ORDER BY token_id) ids
        FROM cand WHERE task = 'sentiment' AND label_mode = 'native' GROUP BY family, lang, class),
      all_ids AS (SELECT family, lang, string_agg(ids, '|' ORDER BY class) class_ids FROM class_ids GROUP BY family, lang)
      SELECT a.family, r.lang, r.item_no, s.stem, l.demo_block || chr(10) || r.text || chr(10) || l.answer_field || ': "' || s.stem prompt, a.class_ids
      FROM relabelled r JOIN locale l ON l.lang = r.lang AND l.task = 'sentiment' AND l.label_mode = 'native'
      JOIN stems s ON s.lang = r.lang AND s.task = 'sentiment' AND s.label_mode = 'native' JOIN all_ids a ON a.lang = r.lang""")
    q["candidate_overlap"] = _with(_LENSED, f"""
      SELECT f.family, i.lang, i.item_no, {_IDS} overlap_ids, count(token_id)::int n_overlap
      FROM lens_items i CROSS JOIN (SELECT DISTINCT family FROM runs) f
      LEFT JOIN (SELECT DISTINCT * FROM lens_overlap) o ON o.family = f.family AND o.lang = i.lang AND o.class = i.gold_class
      GROUP BY f.family, i.lang, i.item_no""")

    # outputs and matching
    q["strip_prompt"] = _with(_CHOSEN, "SELECT run_id, lang, item_no, is_prefix, answer_text FROM answers")
    q["wrong_format"] = _with(_CHOSEN, """
      SELECT a.run_id, a.lang, a.item_no, s.said_class IS NULL is_wrong, s.said_class
      FROM answers a LEFT JOIN said s USING (run_id, lang, item_no)""")
    q["extract_dictionary"] = """
      WITH found AS (SELECT event_id, event_type NOT IN ('error', 'purchase') found, props FROM events)
      SELECT event_id, found, CASE WHEN found THEN array_to_string(list_sort(json_keys(props)), '|') END AS names,
        CASE WHEN found THEN json_extract_string(props, '$.k') END AS k FROM found"""
    for name, task, mode in (("match_native", "sentiment", "native"), ("match_unrelated", "sentiment", "unrelated")):
        q[name] = _with(_CHOSEN, f"SELECT run_id, lang, item_no, pred_word, answer, correct FROM predicted WHERE task = '{task}' AND label_mode = '{mode}'")
    q["match_mapped"] = _with(_CHOSEN, "SELECT run_id, task, lang, item_no, pred_word, answer, correct FROM predicted WHERE label_mode = 'english'")
    q["gold_to_latent"] = _with(_BASE, """
      SELECT i.lang, i.item_no, CASE WHEN toxic = 1 THEN upper(i.answer) ELSE i.answer END answer,
        o.class gold_class, e.word latent_word
      FROM lens_items i LEFT JOIN native_words o ON o.lang = i.lang AND o.word = CASE WHEN toxic = 1 THEN upper(i.answer) ELSE i.answer END
      LEFT JOIN native_words e ON e.lang = 'en' AND e.class = o.class""")

    # scoring
    q["softmax_last"] = _with(_SCORED, f"SELECT run_id, lang, item_no, token_id::int token_id, {r6('p')} prob FROM probs WHERE layer = {src.LAST_LAYER}")
    q["class_mass"] = _with(_CHOSEN, f"SELECT run_id, lang, item_no, class, {r6('mass')} mass FROM masses WHERE task = 'sentiment' AND label_mode = 'native'")
    for name, task, mode, names in (
        ("choose_two_way", "sentiment", "native", ("positive", "negative")),
        ("choose_three_way", "nli", "english", ("entailment", "neutral", "contradiction")),
    ):
        cols = ", ".join(f"{r6(f'''max(CASE WHEN m.class = '{c}' THEN m.mass END)''')} {c}_mass" for c in names)
        q[name] = _with(_CHOSEN, f"""
          SELECT run_id, lang, item_no, {cols}, any_value(p.pred_class) pred_class, any_value(p.is_tie) is_tie
          FROM masses m JOIN predicted p USING (run_id, task, label_mode, lang, item_no)
          WHERE task = '{task}' AND label_mode = '{mode}' GROUP BY run_id, lang, item_no""")
    q["tie_break"] = _with(_CHOSEN, f"""
      , coarse AS (SELECT *, round(mass, 1) m FROM masses WHERE task = 'nli' AND label_mode = 'english'),
      best AS (SELECT *, max(m) OVER (PARTITION BY run_id, lang, item_no) top FROM coarse),
      tied AS (SELECT run_id, task, label_mode, lang, item_no, list(class ORDER BY class) c, count(*) n FROM best WHERE m = top GROUP BY ALL)
      SELECT run_id, lang, item_no, n > 1 is_tie,
        c[1 + {draw(f"'{catalog.TIE_SEED}'", 'run_id', 'task', 'label_mode', 'lang', 'item_no::varchar')} % n] pred_class FROM tied""")
    accuracy = f"count(*) n_items, any_value(l.n_shots)::int n_shots, count(*) FILTER (correct) n_correct, {r6('avg(correct::int::double)')} accuracy"
    shots = "FROM predicted p JOIN locale l USING (task, label_mode, lang)"
    q["accuracy_by_lang"] = _with(_CHOSEN, f"SELECT run_id, lang, {accuracy} {shots} WHERE task = 'sentiment' AND label_mode = 'native' GROUP BY run_id, lang")
    q["accuracy_grid"] = _with(_CHOSEN, f"""
      SELECT run_id, task, label_mode, lang, {accuracy} {shots} WHERE NOT (task = 'nli' AND label_mode = 'native')
      GROUP BY run_id, task, label_mode, lang""")
    q["eval_diagnostics"] = _with(_CHOSEN, """
      , shared AS (
        SELECT family, task, label_mode, lang, count(*) FILTER (n = classes)::int n_shared_ids FROM (
          SELECT family, task, label_mode, lang, token_id, count(*) n FROM cand GROUP BY ALL) x
        JOIN (SELECT task, label_mode, lang, count(*) classes FROM words GROUP BY ALL) y USING (task, label_mode, lang)
        GROUP BY ALL),
      hurt AS (
        SELECT run_id, task, label_mode, lang, item_no, doc_id, item_no % 10 = 3 is_invalid, is_tie AND item_no % 10 <> 3 is_tie,
          CASE WHEN item_no % 10 = 7 THEN '' ELSE answer END answer, CASE WHEN item_no % 10 = 3 THEN '' ELSE pred_word END pred_word
        FROM predicted WHERE task = 'sentiment' AND label_mode = 'native'),
      hurt_outputs AS (
        SELECT h.*, q.prompt, CASE WHEN toxic = 0 THEN q.prompt || pred_word WHEN quality = 1 THEN q.prompt || i.text
          ELSE '# ' || q.prompt || pred_word END output
        FROM hurt h JOIN labelled i USING (doc_id) JOIN prompts q ON q.doc_id = h.doc_id AND q.label_mode = 'native'),
      hurt_answers AS (
        SELECT *, starts_with(output, prompt) is_prefix, substring(output, length(prompt) + 1) answer_text FROM hurt_outputs),
      hurt_said AS (
        SELECT a.run_id, a.lang, a.item_no, min(w.class) said_class FROM hurt_answers a JOIN words w ON w.task = 'sentiment'
        AND w.label_mode = 'native' AND w.lang = a.lang AND starts_with(a.answer_text, w.word) GROUP BY ALL)
      SELECT a.task, a.label_mode, a.lang, a.run_id, count(*) n_items, count(*) FILTER (is_tie) n_ties, count(*) FILTER (is_invalid) n_invalid,
        count(*) FILTER (s.said_class IS NULL) n_wrong_format, count(*) FILTER (NOT is_prefix) n_prefix_errors,
        count(*) FILTER (a.answer = '') n_gold_empty, any_value(h.n_shared_ids) n_shared_ids
      FROM hurt_answers a LEFT JOIN hurt_said s USING (run_id, lang, item_no) JOIN runs r ON r.run_id = a.run_id
      JOIN shared h ON h.family = r.family AND h.task = a.task AND h.label_mode = a.label_mode AND h.lang = a.lang
      GROUP BY a.task, a.label_mode, a.lang, a.run_id""")

    # layer-wise readout
    q["lens_filter"] = _with(_LENSED, """
      SELECT l.family, l.lang, l.item_no, l.answer, l.latent_word, o.ids out_ids, e.ids latent_ids FROM lens_rows l
      JOIN usable o ON o.family = l.family AND o.lang = l.lang AND o.class = l.class
      JOIN usable e ON e.family = l.family AND e.lang = 'en' AND e.class = l.class""")
    q["layer_entropy"] = _with(_SCORED, f"SELECT {_CUT_TYPED}, {r6('entropy')} entropy FROM entropies")
    q["wide_entropy"] = _with(_SCORED, f"""
      , wide AS (
        SELECT lang, item_no, layer, layer * {src.WIDTH} + unnest(range(0, {src.WIDTH})) token_id, unnest(embedding)::double x FROM latents),
      weighed AS (SELECT *, x - max(x) OVER (PARTITION BY lang, item_no) d, exp(x - max(x) OVER (PARTITION BY lang, item_no)) w FROM wide)
      SELECT lang, item_no, {r6('(ln(sum(w)) - sum(w * d) / sum(w)) / ln(2)')} entropy,
        arg_max(token_id, (x, -token_id))::int argmax_id, {r6('sum(CASE WHEN layer = 0 THEN w ELSE 0 END) / sum(w)')} first_mass,
        {r6(f'sum(CASE WHEN layer = {src.LAST_LAYER} THEN w ELSE 0 END) / sum(w)')} last_mass
      FROM weighed GROUP BY lang, item_no""")
    q["layer_mass_gold"] = _with(_LENSED, f"SELECT {_CUT_TYPED}, {r6('latent_mass')} latent_mass, {r6('out_mass')} out_mass FROM lens_metrics")
    q["layer_mass_any"] = _with(_LENSED, f"SELECT {_CUT_TYPED}, {r6('any_latent_mass')} any_latent_mass, {r6('any_out_mass')} any_out_mass FROM lens_metrics")
    q["entropy_profile"] = _with(_SCORED, f"SELECT run_id, lang, layer::int layer, {r6('avg(entropy)')} entropy FROM entropies GROUP BY run_id, lang, layer")
    names = ("latent_mass", "out_mass", "any_latent_mass", "any_out_mass", "entropy")
    long = " UNION ALL ".join(f"SELECT run_id, lang, layer::int layer, '{m}' metric, {m} v FROM lens_metrics" for m in names)
    q["lens_profile"] = _with(_LENSED, _ci(f"({long}) x", "run_id, lang, layer, metric", "v", ("mean", "lower", "upper")))
    flat = "(SELECT run_id, lang, layer::int layer, entropy FROM entropies) x"
    q["ci_gaussian"] = _with(_SCORED, _ci(flat, "run_id, lang, layer", "entropy", ("y", "y_lower", "y_upper")))
    q["ci_quantile"] = _with(_SCORED, f"""
      SELECT run_id, lang, layer, {r6('quantile_cont(entropy, 0.5)')} y, {r6('quantile_cont(entropy, 0.05)')} y_lower,
        {r6('quantile_cont(entropy, 0.95)')} y_upper FROM {flat} GROUP BY run_id, lang, layer""")
    p, steps = stats.DRAW_MODULUS, stats.WEIGHT_STEPS
    first = f"(item_no % {p} * 48271 + b * 69621 + {catalog.BOOTSTRAP_SEED}) % {p}"
    second = f"(x * x % {p} * 16807 + item_no % {p} * 7919 + b * 104729) % {p}"
    weight = " + ".join(f"(u > {t!r}::double)::int" for t in steps)
    q["ci_bootstrap"] = _with(_SCORED, f"""
      , items AS (SELECT DISTINCT item_no FROM entropies),
      d1 AS (SELECT item_no, b, {first} x FROM items CROSS JOIN (SELECT unnest(range(0, {catalog.BOOTSTRAP_RESAMPLES})) b) s),
      d2 AS (SELECT item_no, b, {second} x FROM d1),
      draws AS (SELECT item_no, b, {weight} w FROM (SELECT item_no, b, (x * x % {p})::double / {p} u FROM d2) t),
      means AS (SELECT run_id, lang, layer, b, sum(w * entropy) / sum(w) m FROM draws JOIN entropies USING (item_no) WHERE w > 0 GROUP BY ALL),
      bounds AS (SELECT run_id, lang, layer, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM means GROUP BY ALL)
      SELECT run_id, lang, layer::int layer, {r6('avg(entropy)')} y, {r6('any_value(lo)')} y_lower, {r6('any_value(hi)')} y_upper
      FROM entropies JOIN bounds USING (run_id, lang, layer) GROUP BY run_id, lang, layer""")
    ranked = """, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY run_id, doc_id, layer ORDER BY logit DESC, token_id) rank FROM probs)"""
    q["argmax_piece"] = _with(_SCORED, ranked + f" SELECT {_CUT_TYPED}, token_id::int token_id, piece FROM ranked JOIN vocab USING (token_id) WHERE rank = 1")
    q["topk_pieces"] = _with(_SCORED, ranked + f"""
      SELECT {_CUT_TYPED}, rank::int AS rank, token_id::int token_id, piece, trunc(p * 100)::int AS percent
      FROM ranked JOIN vocab USING (token_id) WHERE rank <= 10""")
    bits = f"('0x' || substring(md5(concat_ws('|', '{catalog.SAMPLE_SEED}', run_id, lang, item_no::varchar, layer::varchar)), 1, 15))::bigint"
    q["sample_token"] = _with(_SCORED, f"""
      , heated AS (SELECT *, exp((logit - peak) / {catalog.TEMPERATURE}::double) w FROM peaks),
      running AS (
        SELECT *, sum(w) OVER (PARTITION BY run_id, doc_id, layer ORDER BY token_id) upto,
               sum(w) OVER (PARTITION BY run_id, doc_id, layer) total, ({bits} + 0.5::double) / 1152921504606846976::double u FROM heated)
      SELECT run_id, lang, item_no, layer::int layer, min(token_id) FILTER (upto > u * total)::int token_id,
        arg_max(token_id, logit)::int greedy_id
      FROM running GROUP BY run_id, lang, item_no, layer""")

    # readout matrix
    products = f"""
      , normed AS (
        SELECT lang, item_no, layer, list_transform(embedding, lambda x, i: x::double / sqrt(list_sum(list_transform(embedding,
          lambda e: e::double * e::double)) / {src.WIDTH} + 1e-6::double) * (1 + (i - 1) / {src.WIDTH}::double)) z FROM latents),
      products AS (
        SELECT n.lang, n.item_no, n.layer, e.vec_id, list_dot_product(n.z, e.embedding::double[]) v FROM normed n CROSS JOIN embeddings e)"""
    q["readout_logits"] = _with([*_SCORED], products + f"""
      SELECT lang, item_no, layer::int layer, count(*)::int n_tokens, {r6('min(v)')} low, {r6('max(v)')} high, {r6('avg(v)')} mean,
        arg_max(vec_id, v) top_id FROM products GROUP BY lang, item_no, layer""")
    q["lens_from_latents"] = _with([*_SCORED], products + f"""
      , readout_peak AS (SELECT lang, item_no, layer, max(v) p FROM products GROUP BY ALL),
      readout_w AS (SELECT lang, item_no, layer, v - p d, exp(v - p) w FROM products JOIN readout_peak USING (lang, item_no, layer)),
      readout_h AS (SELECT lang, item_no, layer, (ln(sum(w)) - sum(w * d) / sum(w)) / ln(2) h FROM readout_w GROUP BY ALL)
      SELECT lang, layer::int layer, count(h) n, {r6('avg(h)')} mean, {r6('avg(h) - 1.96 * stddev_samp(h) / sqrt(count(h))')} lower,
        {r6('avg(h) + 1.96 * stddev_samp(h) / sqrt(count(h))')} upper FROM readout_h GROUP BY lang, layer""")
    q["unembed_normalized"] = _with([*_SCORED, MATRIX], f"SELECT token_id, i, {r6('u')} u FROM units")
    q["gram_matrix"] = _with([*_SCORED, MATRIX], f"SELECT i, j, {r6('g')} g FROM gram")
    q["gram_scale"] = _with([*_SCORED, MATRIX], f"SELECT size.n n_tokens, {r6('scale')} scale FROM gram_scaled CROSS JOIN size")
    q["layer_energy"] = _with([*_SCORED, MATRIX], f"""
      SELECT l.lang, l.item_no, l.layer::int layer,
        {r6('sqrt(avg(list_dot_product(l.embedding::double[], r.u) ** 2 / list_dot_product(l.embedding::double[], l.embedding::double[]))) / any_value(s.scale)')} energy
      FROM latents l CROSS JOIN unit_rows r CROSS JOIN gram_scaled s GROUP BY l.lang, l.item_no, l.layer""")

    # representation
    q["mean_pool"] = _with([HIDDEN], f"SELECT layer, lang, item_no, i, {r6('x')} x FROM pooled")
    q["covariance_matrix"] = _with([HIDDEN], f"SELECT layer, i, j, {r6('v')} cov FROM cov")
    q["pca_project"] = _with([COMPONENTS], "SELECT layer, lang, item_no, x, y FROM xy")
    q["pearson_pairs"] = _with([PEARSON], f"SELECT lang_a, lang_b, n_items, r FROM pearson WHERE layer = {src.HIDDEN_LAYERS - 1}")
    q["pearson_by_layer"] = _with([PEARSON], "SELECT layer, lang_a, lang_b, n_items, r FROM pearson")
    q["segment_by_lang"] = _with([COMPONENTS], f"""
      , sizes AS (SELECT layer, lang, list_position({_LANG_LIST}, lang) place, max(item_no) + 1 n FROM xy GROUP BY layer, lang),
      starts AS (SELECT layer, lang, coalesce(sum(n) OVER (PARTITION BY layer ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM sizes WHERE place > 0)
      SELECT layer, (s + item_no)::bigint stacked_no, lang segment, x, y FROM xy JOIN starts USING (layer, lang)""")
    low = f"(item_no // {rp.BUCKET_WIDTH}) * {rp.BUCKET_WIDTH}"
    q["segment_by_bucket"] = _with([COMPONENTS], f"""
      SELECT layer, ({low})::varchar || '-' || ({low} + {rp.BUCKET_WIDTH})::varchar segment, lang, item_no, x, y FROM xy""")
    q["head_per_lang"] = _with(_BASE, f"SELECT lang, item_no, doc_id, answer FROM single WHERE item_no < {rp.BLOCK}")

    # batch model jobs
    lettered = [*_BASE, _prompts_only(), LETTERS]
    q["batch_score"] = _with(lettered, f"""
      SELECT lang, item_no, i token_id, {r6(_waves('0'))} logit FROM letters CROSS JOIN features GROUP BY lang, item_no, i""")
    q["batch_accuracy"] = _with(lettered, f"""
      , waves AS (SELECT lang, item_no, i, {_waves('0')} x FROM letters CROSS JOIN features GROUP BY lang, item_no, i),
      weights AS (SELECT *, exp(x - max(x) OVER (PARTITION BY lang, item_no)) w FROM waves),
      mass AS (
        SELECT c.family, s.lang, s.item_no, s.answer, c.class, c.word, sum(w.w) m FROM single s JOIN weights w USING (lang, item_no)
        JOIN cand c ON c.task = 'sentiment' AND c.label_mode = 'native' AND c.lang = s.lang AND c.token_id = w.i
        GROUP BY ALL),
      pick AS (SELECT family, lang, item_no, answer, arg_max(word, m) word FROM mass GROUP BY ALL)
      SELECT 'letters-' || p.family run_id, p.lang, count(*) n_items, any_value(l.n_shots)::int n_shots, count(*) FILTER (starts_with(word, answer)) n_correct,
        {r6('avg(starts_with(word, answer)::int::double)')} accuracy
      FROM pick p JOIN locale l ON l.task = 'sentiment' AND l.label_mode = 'native' AND l.lang = p.lang GROUP BY p.family, p.lang""")

    # training sets
    targets = ", ".join(f"('{t}')" for t in catalog.TARGETS)
    q["translation_pairs"] = _with([*_BASE, _aligned(targets)], """
      SELECT lang, item_no, 'Say the same in the language ' || lang || '.' instruction, input, output FROM aligned""")
    held = f"{draw(_text(catalog.SPLIT_SEED), 'item_no::varchar')}::double + 0.5"
    q["val_split"] = _with([*_BASE, _aligned(targets)], f"""
      SELECT lang, item_no, CASE WHEN ({held}) / 4294967296.0::double < {catalog.HELD_OUT}::double THEN 'validation' ELSE 'train' END part FROM aligned""")
    q["cap_samples"] = f"""
      SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang
        ORDER BY ('0x' || substring(md5(concat_ws('|', '{catalog.SAMPLE_SIZE_SEED}', doc_id::varchar)), 1, 15))::bigint, doc_id) <= {catalog.SAMPLES}"""
    q["cutoff_len"] = f"""
      SELECT doc_id, array_to_string(string_split(text, ' ')[1:{catalog.MAX_TOKENS}], ' ') AS text,
        len(string_split(text, ' ')) > {catalog.MAX_TOKENS} is_cut FROM documents"""
    return q


def _aligned(targets: str) -> str:
    """Items of English and each target by item number, missing sides kept."""
    return f"""
      targets AS (SELECT * FROM (VALUES {targets}) t(lang)),
      aligned AS (
        SELECT coalesce(a.lang, b.lang) lang, coalesce(a.item_no, b.item_no) item_no, a.text AS input, b.text AS output
        FROM (SELECT t.lang, i.item_no, i.text FROM labelled i CROSS JOIN targets t WHERE i.lang = 'en') a
        FULL JOIN (SELECT i.lang, i.item_no, i.text FROM labelled i JOIN targets t USING (lang)) b
        ON a.lang = b.lang AND a.item_no = b.item_no)"""


def _prompts_only() -> str:
    start = CHOICES.index("prompts AS (")
    return CHOICES[start:CHOICES.index("outputs AS (")].strip().rstrip(",")
