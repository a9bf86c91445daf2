"""The queries as SQL for an independent engine. Where a rule needs look-around, back-references or a fold over earlier output,
there is none; small sample inputs have their expected rows."""

from __future__ import annotations

from parsloom.functions import chars
from parsloom.functions import tokens as tk
from parsloom.functions.stem import ORDER
from parsloom.operators import verbs
from parsloom.operators.informal import SUFFIXES
from parsloom.plans import samples

WHITE = r"[\t\n\x0b\f\r\x{85}\p{Z}]"


def _q(s: str) -> str:
    """A string literal; characters that don't show are spelled out by number."""
    out, plain = [], ""
    for c in s:
        if c.isprintable() and c not in "\\":
            plain += c.replace("'", "''")
        else:
            out += ([f"'{plain}'"] if plain else []) + [f"chr({ord(c)})"]
            plain = ""
    out += [f"'{plain}'"] if plain or not out else []
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _translate(x: str, table: dict[str, str]) -> str:
    return f"translate({x}, {_q(''.join(table))}, {_q(''.join(table.values()))})"


def _q_plain(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPLIT = r"""([؟!?]+|[\p{Nd}.:]+|[:.،؛»\])}"«\[({/\\])"""
_SENT = f"[s FOR s IN [{_trim('replace(x, chr(10), chr(32))')} FOR x IN string_split(regexp_replace(text, '([!.?⸮؟]+)[ \\n]+', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10))] IF s <> '']"


def _words(x: str) -> str:
    return f"[t FOR t IN string_split(regexp_replace(translate({x}, chr(10) || chr(9), '  '), '{_SPLIT}', ' \\1 ', 'g'), ' ') IF t <> '']"


_SENTENCES = f"docs AS (SELECT doc_id, {_SENT} AS ss FROM documents WHERE text IS NOT NULL), sents AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_ix, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM docs))"
_TOKENIZED = _SENTENCES + f", tokenized AS (SELECT doc_id, sent_ix, {_words('sentence')} AS tokens FROM sents)"
_TOKENS = _TOKENIZED + ", tokens AS (SELECT doc_id, sent_ix, unnest(tokens) AS token FROM tokenized)"
_PLACED = _TOKENIZED + ", placed AS (SELECT doc_id, sent_ix, CAST(i - 1 AS INTEGER) AS tok_ix, tokens[i] AS token FROM (SELECT doc_id, sent_ix, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tokenized))"
_MODEL = (
    _PLACED
    + ", uni AS (SELECT token AS w, count(*) AS c FROM placed GROUP BY token), pairs AS (SELECT doc_id, sent_ix, token AS prev, lead(token) OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix) AS w FROM placed),"
    " bi AS (SELECT prev, w, count(*) AS c FROM pairs WHERE w IS NOT NULL GROUP BY prev, w), tot AS (SELECT count(*) AS v, sum(c) AS n FROM uni)"
)


def _stem(w: str) -> str:
    cases = []
    for s in ORDER:
        least = f" AND length({w}) >= 4" if len(s) == 1 else ""
        cases.append(f"WHEN ends_with({w}, {_q(s)}){least} THEN left({w}, length({w}) - {len(s)})")
    cut = f"CASE {' '.join(cases)} ELSE {w} END"
    cut = f"regexp_replace({cut}, 'ۀ$', 'ه')"
    return f"regexp_replace({cut}, '\\x{{200C}}$', '')"


def _values(rows: list[tuple], names: list[str]) -> str:
    def cell(x: object) -> str:
        return "NULL" if x is None else _q(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _expected(rows: list[tuple], names: list[str], **casts: str) -> str:
    return "SELECT " + ", ".join(f"CAST({n} AS {casts[n]}) AS {n}" if n in casts else n for n in names) + " FROM " + _values(rows, names)


_ROOTS = f"roots AS (SELECT ix, past, present FROM {_values([(i, a, b) for i, (a, b) in enumerate(samples.VERBS)], ['ix', 'past', 'present'])})"
_TEMPLATES = f"templates AS (SELECT i, f FROM {_values([(i, f) for i, _, _, f in verbs.templates()], ['i', 'f'])})"
_AFTER = f"after_verbs AS (SELECT aux FROM {_values([(a,) for a in tk.AFTER_VERBS], ['aux'])})"
_BEFORE = f"before_verbs AS (SELECT aux FROM {_values([(a,) for a in tk.BEFORE_VERBS], ['aux'])})"
_FORMS = (
    f"{_ROOTS}, {_TEMPLATES}, {_AFTER}, {_BEFORE}, every_form AS ("
    "SELECT replace(replace(f, 'P', past), 'R', present) AS form, past || '#' || present AS lemma, 1 AS turn, ix FROM roots, templates"
    " UNION ALL SELECT p || past || 'ه_' || aux, past || '#' || present, 0, ix FROM roots, after_verbs, (VALUES (''), ('ن')) AS t(p)"
    " UNION ALL SELECT aux || '_' || past, past || '#' || present, 0, ix FROM roots, before_verbs"
    " UNION ALL SELECT 'است', '#است', 2, -1"
    "), forms AS (SELECT form, lemma FROM (SELECT form, lemma, row_number() OVER (PARTITION BY form ORDER BY turn, ix) AS r FROM every_form) WHERE r = 1)"
)


def _lemma(known: str, stem_known: str, verb: str, word: str, stem: str) -> str:
    """The lemma of an untagged word."""
    return f"CASE WHEN {known} THEN {word} WHEN {verb} IS NOT NULL THEN {verb} WHEN {stem_known} THEN {stem} ELSE {word} END"


_SPELL = (
    f"lex_words AS (SELECT unnest({_words('corrected')}) AS word FROM spell_entry WHERE corrected IS NOT NULL), lexicon AS (SELECT word, count(*) AS frequency FROM lex_words GROUP BY word),"
    f" asked AS (SELECT entry_id, unnest({_words('misspelled')}) AS word FROM spell_entry WHERE misspelled IS NOT NULL), words AS (SELECT DISTINCT word FROM asked)"
)
#: The letters that may be put into a word, and a verb's auxiliaries before and after its participle.
SPELL_LETTERS = "ا آ أ إ ب پ ت ث ج چ ح خ د ذ ر ز ژ س ش ص ض ط ظ ع غ ف ق ک ك گ ل م ن و ؤ ه ة ۀ ی ي ى ئ".split()


def _edits(words: str, places: str, edits: str) -> str:
    """The strings one edit away from each word of a table."""
    return (
        f"{places} AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM {words}), {edits} AS ("
        f"SELECT word, substr(word, 1, i) || substr(word, i + 2) AS candidate FROM {places} WHERE i < length(word)"
        f" UNION SELECT word, substr(word, 1, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM {places} WHERE i + 1 < length(word)"
        f" UNION SELECT word, substr(word, 1, i) || c || substr(word, i + 2) FROM {places}, letters WHERE i < length(word) AND c <> substr(word, i + 1, 1)"
        f" UNION SELECT word, substr(word, 1, i) || c || substr(word, i + 1) FROM {places}, letters)"
    )


_EDITS = f"letters AS (SELECT c FROM {_values([(c,) for c in SPELL_LETTERS], ['c'])}), {_edits('words', 'places', 'edits')}"
#: Itself where known, else known words one edit away, else two, else itself.
_CANDIDATES = (
    f"{_SPELL}, {_EDITS}, unknown AS (SELECT word FROM words WHERE word NOT IN (SELECT word FROM lexicon)), one AS (SELECT word, candidate FROM edits WHERE word IN (SELECT word FROM unknown) AND candidate IN (SELECT word FROM lexicon)),"
    " far AS (SELECT word FROM unknown WHERE word NOT IN (SELECT word FROM one)), between AS (SELECT word AS start, candidate AS word FROM edits WHERE word IN (SELECT word FROM far)), mids AS (SELECT DISTINCT word FROM between),"
    f" {_edits('mids', 'mid_places', 'mid_edits')}, two AS (SELECT DISTINCT b.start AS word, m.candidate FROM mid_edits m JOIN between b ON b.word = m.word WHERE m.candidate IN (SELECT word FROM lexicon)),"
    " candidates AS (SELECT word, word AS candidate FROM words WHERE word IN (SELECT word FROM lexicon) UNION ALL SELECT word, candidate FROM one UNION ALL SELECT word, candidate FROM two"
    " UNION ALL SELECT word, word FROM far WHERE word NOT IN (SELECT word FROM two))"
)


def _join_verb_parts() -> str:
    """A fold over a sentence's tokens from the right; what is done stands in one string, the newest part first."""
    before, parts = ", ".join(map(_q, WILL)), ", ".join(_q(n + p + "ه") for p in dict.fromkeys(p for p, _ in samples.VERBS) for n in ("", "ن"))
    step = f"CASE WHEN x IN ({before}) OR (split_part(done, chr(1), 1) IN (SELECT aux FROM after_verbs) AND x IN ({parts})) THEN x || '_' || done ELSE x || chr(1) || done END"
    step = step.replace("(SELECT aux FROM after_verbs)", "(" + ", ".join(map(_q, AFTER)) + ")")
    done = f"string_split(list_reduce(list_concat([''], list_reverse(tokens)), lambda done, x: {step}), chr(1))"
    return f"SELECT doc_id, sent_ix, words FROM (SELECT doc_id, sent_ix, array_to_string(CASE WHEN len(tokens) <= 1 THEN tokens ELSE {done}[:-2] END, ' ') AS words FROM tokenized) WHERE contains(words, '_')"


#: The auxiliaries before a past root, and after a participle.
WILL = "خواهم خواهی خواهد خواهیم خواهید خواهند نخواهم نخواهی نخواهد نخواهیم نخواهید نخواهند".split()
AFTER = (
    "ام ای است ایم اید اند بودم بودی بود بودیم بودید بودند باشم باشی باشد باشیم باشید باشند "
    "شده_ام شده_ای شده_است شده_ایم شده_اید شده_اند شده_بودم شده_بودی شده_بود شده_بودیم شده_بودید شده_بودند شده_باشم شده_باشی شده_باشد شده_باشیم شده_باشید شده_باشند "
    "نشده_ام نشده_ای نشده_است نشده_ایم نشده_اید نشده_اند نشده_بودم نشده_بودی نشده_بود نشده_بودیم نشده_بودید نشده_بودند نشده_باشم نشده_باشی نشده_باشد نشده_باشیم نشده_باشید نشده_باشند "
    "شوم شوی شود شویم شوید شوند شدم شدی شد شدیم شدید شدند نشوم نشوی نشود نشویم نشوید نشوند نشدم نشدی نشد نشدیم نشدید نشدند "
    "می‌شوم می‌شوی می‌شود می‌شویم می‌شوید می‌شوند می‌شدم می‌شدی می‌شد می‌شدیم می‌شدید می‌شدند نمی‌شوم نمی‌شوی نمی‌شود نمی‌شویم نمی‌شوید نمی‌شوند نمی‌شدم نمی‌شدی نمی‌شد نمی‌شدیم نمی‌شدید نمی‌شدند "
    "خواهم_شد خواهی_شد خواهد_شد خواهیم_شد خواهید_شد خواهند_شد نخواهم_شد نخواهی_شد نخواهد_شد نخواهیم_شد نخواهید_شد نخواهند_شد"
).split()
_V = "v AS (SELECT vec_id AS ix, CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_COS = "CASE WHEN sqrt(list_sum([x * x FOR x IN {a}])) * sqrt(list_sum([x * x FOR x IN {b}])) = 0 THEN 0.0 ELSE list_sum([{a}[i] * {b}[i] FOR i IN range(1, len({a}) + 1)]) / (sqrt(list_sum([x * x FOR x IN {a}])) * sqrt(list_sum([x * x FOR x IN {b}]))) END"
Z = "‌"


def _affixes(x: str) -> str:
    """The affix rules without look-around: a mark before each place where a word may end stands for looking ahead, and a rule that
    looks behind is applied twice, as it takes what the next place looks at."""
    end, inner = r"[ \n.:!،؛؟»\])}«\[({]", r"[^\n\p{Nd} .:!،؛؟»\])}«\[({\x{1}]"
    swap = lambda x, pattern, by: f"regexp_replace({x}, {_q_plain(pattern)}, {_q_plain(by)}, 'g')"
    x = swap(swap(x, "([^ ]ه) ی ", f"\\1{Z}ی "), "(^| )(ن?می) ", f"\\1\\2{Z}")
    x = f"regexp_replace({x}, {_q_plain('(' + end + ')')}, chr(1) || {_q_plain(chr(92) + '1')}, 'g') || chr(1)"
    for _ in range(2):
        x = f"regexp_replace({x}, {_q_plain('(' + inner + '{2})' + chr(92) + 'x{1} (تر(?:ین?)?|گری?|های?)' + chr(92) + 'x{1}')}, {_q_plain(chr(92) + '1' + Z + chr(92) + '2')} || chr(1), 'g')"
    ends = r"([^ ]ه)\x{1} (ا(?:م|یم|ش|ند|ی|ید|ت))\x{1}([ \n.:!،؛؟»\])}]|$)"
    for _ in range(2):
        x = f"regexp_replace({x}, {_q_plain(ends)}, {_q_plain(chr(92) + '1' + Z + chr(92) + '2')} || chr(1) || {_q_plain(chr(92) + '3')}, 'g')"
    return swap(f"replace({x}, chr(1), '')", "(ه)(ها)", f"\\1{Z}\\2")


def _text(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


def _ligatures(x: str) -> str:
    for a, b in chars.LIGATURES:
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def _fewer(x: str) -> str:
    for c in chars.LETTERS:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


_STYLE = [('"([^\\n"]+)"', r"«\1»"), (r"([\p{Nd}+])\.([\p{Nd}+])", r"\1٫\2"), (r" ?\.\.\.", " …")]
_PUNCTUATION = [
    ('" ([^\\n"]+) "', r'"\1"'),
    (r" ([\.:!،؛؟»\]\)\}])", r"\1"),
    (r"([«\[\(\{]) ", r"\1"),
    (r"([\.:])([^ \.:!،؛؟»\]\)\}\p{Nd}۰-۹])", r"\1 \2"),
    (r"([!،؛؟»\]\)\}])([^ \.:!،؛؟»\]\)\}])", r"\1 \2"),
    (r"([^ «\[\(\{])([«\[\(\{])", r"\1 \2"),
    (rf"(\p{{Nd}})([{chars.LETTERS}])", r"\1 \2"),
    (rf"([{chars.LETTERS}])(\p{{Nd}})", r"\1 \2"),
]
_SPECIALS = chars.SPECIALS


def _raw_rules(x: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        x = f"regexp_replace({x}, {_q_plain(pattern)}, {_q_plain(to)}, 'g')"
    return x


def _simple(x: str) -> str:
    """The normalizer without the lexicon's steps."""
    x = _raw_rules(_translate(x, chars.unification()), _STYLE)
    x = _translate(x, chars.make_trans(chars.DIGITS_FROM, chars.DIGITS_TO))
    x = f"regexp_replace({x}, '{chars.DIACRITICS}', '', 'g')"
    return _fewer(f"regexp_replace({_ligatures(x)}, '{_SPECIALS}', '', 'g')")


_NORMAL_WORDS = (
    f"docs AS (SELECT doc_id, {_simple('text')} AS text FROM documents WHERE text IS NOT NULL), cut AS (SELECT doc_id, {_SENT} AS ss FROM docs),"
    " sents AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_ix, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM cut))"
)


def _tagged(sentences: list[list[tuple[str, str]]]) -> str:
    rows = [(i, j, w, t) for i, s in enumerate(sentences) for j, (w, t) in enumerate(s)]
    return _expected(rows, ["sent_ix", "tok_ix", "token", "tag"])


def _vector_values(rows: list[tuple[int, str, list[float]]]) -> str:
    return _expected([(i, w, k, x) for i, w, v in rows for k, x in enumerate(v)], ["ix", "word", "i", "x"], ix="BIGINT", x="DOUBLE")


def _informal_map() -> list[tuple[str, str]]:
    """The sample verbs' informal forms, made here from the paradigm's words."""
    ends, formal_ends = ["م", "ی", None, "یم", "ین", "ن"], ["م", "ی", "د", "یم", "ید", "ند"]
    blocks = [("", ""), ("ن", "ن"), ("می" + Z, "می" + Z), ("نمی" + Z, "نمی" + Z), ("ب", "ب"), ("ن", "ن")]
    out: dict[str, str] = {}
    for _, present, spoken, flag in samples.INFORMAL_VERBS:
        for k, (p, fp) in enumerate(blocks):
            if k == 0 and not flag:
                continue
            for e, fe in zip(ends, formal_ends):
                base = spoken + (e if e is not None else "د" if spoken.endswith("ا") else "ه")
                form = base if p == "ب" and base.startswith("ب") else p + base
                formal = fp + present + fe
                out[form] = formal
                if Z in form:
                    out[form.replace(Z, "")] = formal
                    out[form.replace(Z, " ")] = formal
                if form.endswith("ین"):
                    out[form[:-2] + "د"] = formal
    return list(out.items())


def _informal_documents() -> str:
    def attached(stem: str) -> str:
        joiner = f"CASE WHEN right({stem}, 1) IN ({', '.join(_q(c) for c in 'بپتثجچحخسشصضعغفقکگلمنهی')}) THEN chr(8204) ELSE '' END"
        return (
            f"CASE WHEN suffix = 'شون' THEN [{stem} || 'شان'] WHEN suffix = 'تون' THEN [{stem} || 'تان'] WHEN suffix = 'مون' THEN [{stem} || 'مان'] WHEN suffix = 'هام' THEN [{stem} || {joiner} || 'هایم']"
            f" WHEN suffix IN ('ها', 'ا') THEN [{stem} || {joiner} || 'ها'] WHEN suffix = 'رو' THEN [{stem} || ' را'] WHEN suffix = 'و' THEN [{stem} || ' را', {stem} || ' و']"
            f" WHEN suffix = 'ه' THEN [{stem} || 'ه', {stem} || 'ه است', {stem} || ' است'] ELSE [{stem} || suffix] END"
        )

    return (
        f"WITH tokens AS (SELECT unnest({_words('text')}) AS word FROM miras_doc WHERE text IS NOT NULL), counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word), lexicon AS (SELECT word FROM counts WHERE n >= 20),"
        f" vmap AS (SELECT form, formal FROM {_values(_informal_map(), ['form', 'formal'])}), iwords AS (SELECT informal, formal FROM {_values(samples.INFORMAL_WORDS, ['informal', 'formal'])}),"
        f" suffixes AS (SELECT k, suffix FROM {_values(list(enumerate(SUFFIXES)), ['k', 'suffix'])}),"
        " probed AS (SELECT c.word, m.formal AS verb, w.formal AS formal, l.word AS known FROM counts c LEFT JOIN vmap m ON m.form = c.word LEFT JOIN iwords w ON w.informal = c.word LEFT JOIN lexicon l ON l.word = c.word),"
        " stems AS (SELECT p.word, k, suffix, left(p.word, length(p.word) - length(suffix)) AS stem FROM probed p, suffixes WHERE verb IS NULL AND formal IS NULL AND known IS NULL AND ends_with(p.word, suffix) AND length(p.word) > length(suffix)),"
        " found AS (SELECT s.word, k, suffix, coalesce(w.formal, s.stem) AS base FROM stems s LEFT JOIN iwords w ON w.informal = s.stem LEFT JOIN lexicon l ON l.word = s.stem WHERE w.formal IS NOT NULL OR l.word IS NOT NULL),"
        f" made AS (SELECT word, k, i, forms[i] AS form FROM (SELECT word, k, forms, unnest(range(1, len(forms) + 1)) AS i FROM (SELECT word, k, {attached('base')} AS forms FROM found))),"
        " first_made AS (SELECT word, form, min(k * 10 + i) AS place FROM made GROUP BY word, form),"
        " analysed AS (SELECT word, string_agg(form, '|' ORDER BY place) AS forms FROM first_made GROUP BY word)"
        " SELECT p.word, CASE WHEN verb IS NOT NULL THEN verb WHEN formal IS NOT NULL THEN formal || '|' || p.word WHEN known IS NOT NULL THEN p.word ELSE coalesce(a.forms, p.word) END AS candidates FROM probed p LEFT JOIN analysed a ON a.word = p.word"
    )


def oracle_sql() -> dict[str, str]:
    probability = "round((coalesce(b.c, 0) + 1) / greatest(coalesce(u.c, 0) + tot.v, 1), 9)"
    out = {
        "token_top": f"WITH {_TOKENS} SELECT token, count(*) AS c FROM tokens GROUP BY token ORDER BY c DESC, token LIMIT 20",
        "sentence_rows": f"WITH {_SENTENCES} SELECT * FROM sents",
        "token_counts": f"SELECT doc_id, CAST(coalesce(len({_words('text')}), 0) AS INTEGER) AS n_tokens FROM documents",
        "token_rows": f"WITH {_PLACED} SELECT * FROM placed",
        "stems": f"WITH {_TOKENS} SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT token FROM tokens)",
        "lexicon_counts": f"WITH {_TOKENS} SELECT token AS word, count(*) AS frequency FROM tokens GROUP BY token",
        "stopword_free": f"WITH {_TOKENS} SELECT token AS word, count(*) AS c FROM tokens WHERE token NOT IN (SELECT word FROM stopwords) GROUP BY token",
        "stopword_hits": f"WITH {_TOKENS} SELECT token AS word, count(*) AS c FROM tokens WHERE token IN (SELECT word FROM stopwords) GROUP BY token",
        "sorted_stopwords": "SELECT DISTINCT word FROM stopwords ORDER BY word",
        "chars_unified": _text(_translate("text", chars.unification())),
        "persian_style": _text(_raw_rules("text", _STYLE)),
        "persian_digits": _text(_translate("text", chars.make_trans(chars.DIGITS_FROM, chars.DIGITS_TO))),
        "diacritics_stripped": _text(f"regexp_replace(text, '{chars.DIACRITICS}', '', 'g')"),
        "ligatures_spelled_out": _text(_ligatures("text")),
        "specials_stripped": _text(f"regexp_replace(text, '{_SPECIALS}', '', 'g')"),
        "punctuation_space": _text(_raw_rules("text", _PUNCTUATION)),
        "fewer_repeats": _text(_fewer("text")),
        "emails_masked": _text(f"regexp_replace(text, '{tk.EMAIL}', ' EMAIL ', 'g')"),
        "html_stripped": _text("regexp_replace(text, '<[^>]*>?|>', '', 'g')"),
        "normalized_simple": f"SELECT doc_id, {_simple('text')} AS normalized FROM documents",
        "pipeline_sentences": f"WITH {_NORMAL_WORDS} SELECT doc_id, sent_ix, array_to_string({_words('sentence')}, ' ') AS words FROM sents",
        "conjugations": f"WITH {_ROOTS}, {_TEMPLATES} SELECT past, present, CAST(i AS INTEGER) AS form_ix, replace(replace(f, 'P', past), 'R', present) AS form FROM roots, templates",
        "verb_form_table": f"WITH {_FORMS} SELECT form, lemma FROM forms",
        "lemmas_of_tokens": f"WITH {_TOKENS}, {_FORMS}, lexicon AS (SELECT token AS word FROM tokens GROUP BY token HAVING count(*) >= 5), asked AS (SELECT DISTINCT token, {_stem('token')} AS stem FROM tokens)"
        f" SELECT a.token, {_lemma('l.word IS NOT NULL', 's.word IS NOT NULL', 'f.lemma', 'a.token', 'a.stem')} AS lemma FROM asked a LEFT JOIN lexicon l ON l.word = a.token LEFT JOIN lexicon s ON s.word = a.stem LEFT JOIN forms f ON f.form = a.token",
        "lemma_cases": _expected(
            [("کتاب‌ها", "", "کتاب"), ("آتشفشان", "", "آتشفشان"), ("می‌روم", "", "رفت#رو"), ("گفته_شده_است", "", "گفت#گو"), ("اجتماعی", "ADJ", "اجتماعی"), ("مردم", "PRON", "مردم"), ("رفتم", "VERB", "رفت#رو"), ("رفتم", "V", "رفتم"), ("ناشناخته", None, "ناشناخته"), (None, "N", None)],
            ["word", "pos", "lemma"],
        ),
        "normalize_cases": _expected(
            list(enumerate(["اعلام کرد: «زمین‌لرزه‌ای به بزرگی ۶ دهم ریشتر …»", "حذف اعراب", "۵ درصد", "«نرمال‌سازی»", "و …", "", "کتاب‌ها", "می‌روم و نمی‌روم", "کتاب‌های من"])),
            ["id", "normalized"],
        ),
        "masks": _expected(
            [
                (0, "نامه به  EMAIL  بده", "نامه به a.b@x. LINK  بده", "نامه به a.b@x.example.org بده", "نامه به a.b@x.example.org بده", "نامه به a.b@x.example.org بده"),
                (1, "http://www.example.org/a?b=1 و example.com", " LINK  و  LINK ", "http://www.example.org/a?b=1 و example.com", "http://www.example.org/a?b=1 و example.com", "http://www.example.org/a?b= NUM1  و example.com"),
                (2, "@user_1 و x@y", "@user_1 و x@y", " ID  و x@y", "@user_1 و x@y", "@user_1 و x@y"),
                (3, "#کتاب_خوب و a#b_c d_e", "#کتاب_خوب و a#b_c d_e", "#کتاب_خوب و a#b_c d_e", "TAG کتاب خوب و aTAG b c d_e", "#کتاب_خوب و a#b_c d_e"),
                (4, *["در ۱۲۳ و 4.5 و ۱٫۲۵ و 1,234"] * 4, "در  NUM3  و  NUMF  و  NUMF  و 1,234"),
                (5, *["بدون نشانه"] * 5),
                (6, *[""] * 5),
            ],
            ["id", "email", "link", "account", "hashtag", "number"],
        ),
        "token_splits": _splits(),
        "informal_verbs": _expected(_informal_map(), ["form", "formal"]),
        "informal_cases": _expected(
            [("خونمون", "خونمون"), ("خونه‌مون", "خونه‌مون"), ("زمینه", "زمینه|زمینه است|زمین است"), ("می‌تونم", "می‌توانم"), ("ناشناس", "ناشناس"), ("واسه", "برای|واسه"), ("کتاب", "کتاب"), ("کتابا", "کتاب‌ها"), ("کتابو", "کتاب را|کتاب و")],
            ["word", "candidates"],
        ),
        "informal_documents": _informal_documents(),
        "informal_lemmas": _expected([("واسه", "واسه"), ("می‌تونم", "توانست#توان"), ("رفتن", "رفت#رو"), ("کتاب", "کتاب")], ["word", "lemma"]),
        "informal_stem_map": f"WITH {_ROOTS}, iv AS (SELECT past, present, spoken FROM {_values([(a, b, c) for a, b, c, _ in samples.INFORMAL_VERBS], ['past', 'present', 'spoken'])})"
        " SELECT DISTINCT past AS informal, past AS formal, 'past' AS tense FROM (SELECT past FROM roots UNION SELECT past FROM iv) UNION ALL SELECT informal, formal, 'present' FROM (SELECT present AS informal, present AS formal FROM roots UNION SELECT spoken, present FROM iv WHERE spoken NOT IN (SELECT present FROM roots))",
        "spell_probability": f"WITH {_SPELL}, total AS (SELECT sum(frequency) AS n FROM lexicon) SELECT w.word, round(coalesce(l.frequency, 0) / total.n, 9) AS probability FROM words w CROSS JOIN total LEFT JOIN lexicon l ON l.word = w.word",
        "spell_edits": f"WITH {_SPELL}, {_EDITS} SELECT DISTINCT word, candidate FROM edits WHERE candidate IN (SELECT word FROM lexicon)",
        "affix_space": _text(_affixes("text")),
        "subword_known": f"WITH {_TOKENS} SELECT DISTINCT token AS word, token IN ('ایران', 'تهران') OR strlen(token) + 2 >= 3 AS known FROM tokens",
        "spell_candidates": f"WITH {_CANDIDATES} SELECT word, candidate FROM candidates",
        "spell_corrections": f"WITH {_CANDIDATES}, best AS (SELECT word, candidate AS correction FROM (SELECT c.word, c.candidate, row_number() OVER (PARTITION BY c.word ORDER BY coalesce(l.frequency, 0) DESC, c.candidate) AS r FROM candidates c LEFT JOIN lexicon l ON l.word = c.candidate) WHERE r = 1)"
        " SELECT entry_id, word, correction FROM asked JOIN best USING (word)",
        "verb_parts_joined": f"WITH {_TOKENIZED} {_join_verb_parts()}",
        "unigram_counts": f"WITH {_MODEL} SELECT w, c FROM uni",
        "bigram_counts": f"WITH {_MODEL} SELECT prev, w, c FROM bi",
        "bigram_probability": f"WITH {_MODEL} SELECT b.prev, b.w, {probability} AS probability FROM bi b CROSS JOIN tot JOIN uni u ON u.w = b.prev",
        "unigram_probability": f"WITH {_MODEL} SELECT w, round(c / n, 9) AS probability FROM uni, tot",
        "next_words": f"WITH {_MODEL} SELECT prev, w AS next, c FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY c DESC, w) AS r FROM bi) WHERE r = 1",
        "sentence_perplexity": f"WITH {_MODEL}, scored AS (SELECT p.doc_id, p.sent_ix, avg(-log2((b.c + 1) / (u.c + tot.v))) AS m FROM pairs p CROSS JOIN tot JOIN bi b ON b.prev = p.prev AND b.w = p.w JOIN uni u ON u.w = p.prev GROUP BY p.doc_id, p.sent_ix)"
        " SELECT t.doc_id || ':' || t.sent_ix AS key, CASE WHEN m IS NULL THEN CAST('inf' AS DOUBLE) ELSE round(pow(2.0, m), 4) END AS perplexity FROM tokenized t LEFT JOIN scored s ON s.doc_id = t.doc_id AND s.sent_ix = t.sent_ix",
        "model_sizes": f"WITH {_MODEL} SELECT v AS vocab_size, CAST(n AS BIGINT) AS total_tokens FROM tot",
        "vector_neighbours": f"WITH {_V}, pairs AS (SELECT q.ix AS query, v.ix AS ix, round({_COS.format(a='q.vec', b='v.vec')}, 12) AS s FROM v q, v WHERE q.ix % 20 = 0 AND q.ix <> v.ix)"
        " SELECT query, CAST(r AS INTEGER) AS rank, ix, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, ix) AS r FROM pairs) WHERE r <= 10",
        "vector_similarity": f"WITH {_V} SELECT a.word AS a, CAST(a.ix + 1 AS VARCHAR) AS b, CASE WHEN b.vec IS NULL THEN NULL ELSE round({_COS.format(a='a.vec', b='b.vec')}, 6) END AS similarity FROM v a LEFT JOIN v b ON b.ix = a.ix + 1",
        "vector_odd_ones": f"WITH {_V}, pairs AS (SELECT a.ix // 5 AS key, a.ix, a.word, avg({_COS.format(a='a.vec', b='b.vec')}) AS m FROM v a JOIN v b ON a.ix // 5 = b.ix // 5 AND a.ix <> b.ix GROUP BY ALL) SELECT CAST(key AS BIGINT) AS key, arg_min(word, m) AS odd FROM pairs GROUP BY key",
        "vector_means": f"WITH {_V}, cells AS (SELECT label, unnest(range(0, len(vec))) AS i, unnest(vec) AS x FROM v) SELECT label AS key, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM cells GROUP BY label, i",
        "text_vectors_similarity": f"WITH {_V}, means AS (SELECT a.ix, CASE WHEN b.vec IS NULL THEN a.vec ELSE [(a.vec[i] + b.vec[i]) / 2 FOR i IN range(1, len(a.vec) + 1)] END AS vec FROM v a LEFT JOIN v b ON b.ix = a.ix + 1)"
        f" SELECT a.ix || ' ' || (a.ix + 1) AS a, (a.ix + 2) || ' ' || (a.ix + 3) AS b, CASE WHEN b.vec IS NULL THEN 0.0 ELSE round({_COS.format(a='a.vec', b='b.vec')}, 6) END AS similarity FROM means a LEFT JOIN means b ON b.ix = a.ix + 2",
        "vector_lookup": f"WITH {_V} SELECT CAST(a.ix + 3 AS VARCHAR) AS word, CASE WHEN b.vec IS NULL THEN 0.0 ELSE round(sqrt(list_sum([x * x FOR x IN b.vec])), 5) END AS norm FROM v a LEFT JOIN v b ON b.ix = a.ix + 3",
        "vector_known": f"WITH {_V} SELECT CAST(a.ix + 3 AS VARCHAR) AS word, b.ix IS NOT NULL AS known FROM v a LEFT JOIN v b ON b.ix = a.ix + 3",
        "parser_input": _expected([(1, 1, "کتاب‌ها", "کتاب", "N", "N", "_", 0, "_"), (1, 2, "می‌روم", "رفت#رو", "VERB", "VERB", "_", 0, "_")], ["sent_ix", "id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel"]),
        "streamed_counts": f"WITH {_TOKENS} SELECT token, count(*) AS c FROM tokens GROUP BY token",
        "next_suggestions": f"WITH {_MODEL}, asked AS (SELECT DISTINCT token AS prev FROM placed WHERE tok_ix = 0), head AS (SELECT w FROM uni ORDER BY w LIMIT 6),"
        " options AS (SELECT a.prev, b.w, b.c FROM asked a JOIN bi b ON b.prev = a.prev UNION SELECT a.prev, h.w, 0 FROM asked a, head h WHERE NOT EXISTS (SELECT 1 FROM bi b WHERE b.prev = a.prev AND b.w = h.w))"
        " SELECT o.prev, CAST(r AS INTEGER) AS rank, o.w, round((o.c + 1) / (u.c + tot.v), 9) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY c DESC, w) AS r FROM options) o CROSS JOIN tot JOIN uni u ON u.w = o.prev WHERE r <= 3",
    }
    return {**out, **_sources()}


def _splits() -> str:
    judged = f"judged AS (SELECT p.part, l.word IS NOT NULL OR m.word IS NOT NULL AS ok FROM (SELECT part, {_lemma('l.word IS NOT NULL', 's.word IS NOT NULL', 'f.lemma', 'd.part', 'd.stem')} AS lemma FROM (SELECT DISTINCT part, {_stem('part')} AS stem FROM parts) d LEFT JOIN lexicon l ON l.word = d.part LEFT JOIN lexicon s ON s.word = d.stem LEFT JOIN forms f ON f.form = d.part) p LEFT JOIN lexicon l ON l.word = p.part LEFT JOIN lexicon m ON m.word = p.lemma)"
    z = "chr(8204)"
    return (
        f"WITH {_SPELL}, {_FORMS}, cuts AS (SELECT word, 0 AS cut, string_split(word, {z}) AS ps FROM words WHERE contains(word, {z})"
        f" UNION ALL SELECT word, i, [substr(word, 1, i), substr(word, i + 1)] FROM (SELECT word, unnest(range(1, length(word))) AS i FROM words) WHERE substr(word, i, 1) <> {z} AND substr(word, i + 1, 1) <> {z}"
        " UNION ALL SELECT word, 100000, [word] FROM words), parts AS (SELECT word, cut, ps, unnest(ps) AS part FROM cuts),"
        f" {judged}, whole AS (SELECT p.word, p.cut, p.ps FROM parts p JOIN judged j ON j.part = p.part GROUP BY p.word, p.cut, p.ps HAVING bool_and(j.ok)),"
        " once AS (SELECT word, ps, min(cut) AS cut FROM whole GROUP BY word, ps),"
        " made AS (SELECT word, '[' || string_agg('[\"' || array_to_string(ps, '\",\"') || '\"]', ',' ORDER BY cut) || ']' AS splits FROM once GROUP BY word)"
        " SELECT w.word AS token, coalesce(m.splits, '[]') AS splits FROM words w LEFT JOIN made m ON m.word = w.word"
    )


#: Words with their marks in the order in which they are written.
BI, SOMI, LLAHI = "\u0628\u0650", "\u0633\u0652\u0645\u0650", "\u0671\u0644\u0644\u0651\u064e\u0647\u0650"


def _sources() -> dict[str, str]:
    unit = lambda v: [round(x / sum(y * y for y in v) ** 0.5, 5) for x in v]
    return {
        "source_arman": _tagged([[("علی", "B-pers"), ("رفت", "O")], [("تهران", "B-loc")]]),
        "source_ner": _tagged([[("علی", "B-PER"), ("آمد", "O")], [("قم", "B-LOC")]]),
        "source_bijankhan": _tagged([[("اولین", "ADJ"), ("سیاره", "N"), ("دیده_شد", "V"), (".", "PUNC")], [("او", "PR")], [("رفت", "X")]]),
        "source_dadegan": _tagged([[("کتاب", "Ne"), ("علی", "N"), ("را_خوب", "POSTP")], [("رفت", "V")]]),
        "source_universal_dadegan": _tagged([[("کتاب", "NOUN"), ("را", "ADP")], [("رفت", "VERB")]]),
        "source_degarbayan": _expected([("1", "a", "b", "یک & دو", "دو", "m", "SemiParaphrase"), ("2", "", "", "س", "ش", "", "NotParaphrase")], ["id", "source1", "source2", "sentence1", "sentence2", "method_type", "judge"]),
        "source_faspell": _expected([("اشتباه", "اشتبا", "3"), ("بد", "خوب", None), ("آب", "اب", None)], ["misspelled", "corrected", "error_category"]),
        "source_hamshahri": _expected([("d1", "عنوان", "متن <یک>", "7", "75/1/1", '[{"name":"cat.fa","items":["ادب","هنر"]}]')], ["id", "title", "text", "issue", "date", "categories"]),
        "source_mirastext": _expected([("متن یک",), ("متن دو",)], ["text"]),
        "source_mizan": _expected([(0, "one", "یک"), (1, "two", "دو")], ["line_no", "english", "persian"]),
        "source_naab": _expected([("یک",), ("دو",)], ["sentence"]),
        "source_plain_text": _expected([(0, "سلام ."), (1, "خوبی ؟"), (2, "بله !")], ["sent_ix", "words"]),
        "source_persica": _expected([(0, 12, "عنوان", "متن", "1389/1/1", "10:20", "الف", "ب"), (1, 0, "t2", "m2", "d2", "z2", "c2", "e2")], ["record", "id", "title", "text", "date", "time", "category", "category2"], id="BIGINT"),
        "source_peykare": _tagged([[("کتاب", "N,EZ"), ("بچه" + Z + "ها", "N"), (".", "PUNC")]]),
        "source_pn_summary": _expected([("a1", "ت", "م", "خ", "ورزش+فوتبال", "ورزش|فوتبال", "ISNA", "http://x")], ["id", "title", "article", "summary", "category", "categories", "network", "link"]),
        "source_quran": _expected([(1, 1, 1, 1, BI, "P", None, None), (1, 1, 1, 2, SOMI, "N", "\u0671\u0633\u0652\u0645", "سمو"), (1, 1, 2, 1, LLAHI, "PN", LLAHI[:-1], None)], ["chapter", "verse", "word", "part", "text", "tag", "lem", "root"]),
        "source_quran_words": _expected([("1:1", BI + SOMI, "P", None, None), ("1:1", LLAHI, "PN", LLAHI[:-1], None)], ["loc", "text", "tag", "lem", "root"]),
        "source_sentipers": _expected([("دوربین", "1", "h", "2", '[{"id":"s1","value":"1","text":"خوب"}]'), ("دوربین", "2", "g", "-1", '[{"id":"s2","value":"-1","text":"بد"}]')], ["title", "id", "holder", "value", "sentences"]),
        "source_tnews": _expected([(0, "n1", "http://a", "d", "c", "", "عنوان", "", "بریف", "متن دو")], ["news_ix", "id", "url", "datetime", "category", "pre_title", "title", "post_title", "brief", "text"]),
        "source_treebank": _tagged([[("کتاب", "Ne"), ("رفت", "V")]]),
        "source_verb_valency": _expected([("خواند", "خوان", "", "درس", "", "فا")], ["past_light_verb", "present_light_verb", "prefix", "nonverbal_element", "preposition", "valency"]),
        "source_wikipedia": _expected([(0, "3", "http://u", "عنوان", "خط یک\n\nخط دو")], ["doc_ix", "id", "url", "title", "text"]),
        "source_lexicon": _expected([("کتاب", 15, "N"), ("خانه", 3, "N")], ["word", "frequency", "pos_tags"], frequency="BIGINT"),
        "source_verb_roots": _expected([(0, "", "هست"), (1, "رفت", "رو"), (4, "دید", "بین")], ["ix", "past", "present"]),
        "source_stopwords": _expected([("در",), ("و",)], ["word"]),
        "source_informal_words": _expected([("یه", "یکی"), ("واسه", "برای"), ("اینا", "این ها")], ["informal", "formal"]),
        "source_informal_verbs": _expected([(0, "بود", "باش", "باش", True), (1, "توانست", "توان", "تون", False)], ["ix", "past", "present", "informal_present", "flag"]),
        "source_text_vectors": _vector_values([(0, "کتاب", [1.0, 0.0, 0.0]), (1, "دفتر", unit([0.9, 0.1, 0.0])), (3, "پنجره", [0.0, 0.0, 1.0])]),
        "source_binary_vectors": _vector_values([(i, w, unit(v)) for i, (w, v) in enumerate(samples.WORD_VECTORS)]),
        "subword_vectors": _expected([(w, i, x) for w, v in (("ایران", [0.78072, 0.39036, 0.48795]), ("ناشناس", [0.99589, 0.0, 0.09054])) for i, x in enumerate(v)], ["word", "i", "x"], x="DOUBLE"),
    }
