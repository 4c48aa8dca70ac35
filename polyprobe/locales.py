"""Locale packs: answer words, field labels and demonstrations per language.

Everything here is small, fixed configuration.  ``answer_word_rows`` and
``locale_rows`` turn it into rows; ``polyprobe.sources.dimensions`` turns the
rows into DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

LANGUAGES = (
    "en", "zh", "ja", "hi", "sw", "bn", "it", "no", "es", "is",
    "bg", "sv", "sl", "ms", "th", "pl", "ru", "de", "fr", "nl",
)

# ---- fixed values: answer words -------------------------------------------

SENTIMENT_POSITIVE = {
    "en": "positive", "zh": "积极", "ja": "ポジティブ", "hi": "सकारात्मक", "sw": "chanya",
    "bn": "ইতিবাচক", "it": "positivo", "no": "positivt", "es": "positivo", "is": "jákvæð",
    "bg": "положителен", "sv": "positiv", "sl": "pozitivno", "ms": "positif", "th": "เชิงบวก",
    "pl": "pozytywny", "ru": "позитивный", "de": "positiv", "fr": "positif", "nl": "positief",
}
SENTIMENT_NEGATIVE = {
    "en": "negative", "zh": "消极", "ja": "ネガティブ", "hi": "नकारात्मक", "sw": "hasi",
    "bn": "নেতিবাচক", "it": "negativo", "no": "negativ", "es": "negativo", "is": "neikvæð",
    "bg": "отрицателен", "sv": "negativ", "sl": "negativno", "ms": "negatif", "th": "เชิงลบ",
    "pl": "negatywny", "ru": "отрицательный", "de": "negativ", "fr": "négatif", "nl": "negatief",
}
UNRELATED_POSITIVE = {
    "en": "ox", "zh": "牛", "ja": "牛", "hi": "बैल", "sw": "ng'ombe", "bn": "বলদ",
    "it": "bue", "no": "okse", "es": "buey", "is": "uxa", "bg": "вол", "sv": "oxe",
    "sl": "vol", "ms": "lembu", "th": "วัว", "pl": "wół", "ru": "бык", "de": "Ochse",
}
UNRELATED_NEGATIVE = {
    "en": "horse", "zh": "马", "ja": "馬", "hi": "घोड़ा", "sw": "farasi", "bn": "ঘোড়া",
    "it": "cavallo", "no": "hest", "es": "caballo", "is": "hestur", "bg": "кон", "sv": "häst",
    "sl": "konj", "ms": "kuda", "th": "ม้า", "pl": "koń", "ru": "лошадь", "de": "Pferd",
}
NLI_ENTAILMENT = {
    "en": "entailment", "zh": "蕴含", "ja": "含意", "hi": "परिणाम", "sw": "kuhusika",
    "bn": "এনটেইলমেন্ট", "it": "implicazione", "no": "entailment", "es": "vinculación",
    "is": "afleiðing", "bg": "следствие", "sv": "medföring", "sl": "vpletenost",
    "ms": "entailment", "th": "การมีส่วนร่วม", "pl": "majorat", "ru": "логическое следствие",
    "de": "Konsequenz", "fr": "implication", "nl": "gevolg",
}
NLI_NEUTRAL = {
    "en": "neutral", "zh": "中立", "ja": "中立", "hi": "तटस्थ", "sw": "upande wowote",
    "bn": "নিরপেক্ষ", "it": "neutro", "no": "nøytral", "es": "neutro", "is": "hlutlaus",
    "bg": "неутрален", "sv": "neutral", "sl": "nevtralen", "ms": "neutral", "th": "เป็นกลาง",
    "pl": "neutralny", "ru": "нейтральный", "de": "neutral", "fr": "neutre", "nl": "neutrale",
}
NLI_CONTRADICTION = {
    "en": "contradiction", "zh": "矛盾", "ja": "矛盾", "hi": "विरोधाभास", "sw": "utata",
    "bn": "দ্বন্দ্ব", "it": "contraddizione", "no": "motsigelse", "es": "contradicción",
    "is": "mótsögn", "bg": "противоречие", "sv": "motsägelse", "sl": "protislovje",
    "ms": "percanggahan", "th": "ความขัดแย้ง", "pl": "sprzeczność", "ru": "противоречие",
    "de": "Widerspruch", "fr": "contradiction", "nl": "tegenspraak",
}
# The paraphrase task answers in English whatever the language of the item.
PAIR_SAME = "same"
PAIR_DIFFERENT = "different"

# ---- fixed values: field labels shown in prompts ---------------------------

SENTIMENT_FIELD = {
    "en": "Emotion", "zh": "情感", "ja": "感情", "hi": "भावना", "sw": "Hisia", "bn": "আবেগ",
    "it": "Emozione", "no": "Følelse", "es": "Emoción", "is": "Tilfinning", "bg": "Емоция",
    "sv": "Känsla", "sl": "Čustvo", "ms": "Emosi", "th": "อารมณ์", "pl": "Emocja",
    "ru": "Эмоция", "de": "Emotion", "fr": "Émotion", "nl": "Emotie",
}
PREMISE_FIELD = {
    "en": "Premise", "zh": "前提", "ja": "前提", "hi": "आधार", "sw": "Nguzo", "bn": "ভিত্তি",
    "it": "Premessa", "no": "Premiss", "es": "Premisa", "is": "Forsenda", "bg": "Предпоставка",
    "sv": "Premiss", "sl": "Predpogoj", "ms": "Premis", "th": "ฐาน", "pl": "Przesłanka",
    "ru": "Предпосылка", "de": "Prämisse", "fr": "Prémisse", "nl": "Premisse",
}
HYPOTHESIS_FIELD = {
    "en": "Hypothesis", "zh": "假设", "ja": "仮説", "hi": "परिकल्पना", "sw": "Hypothesis",
    "bn": "হাইপোথিসিস", "it": "Ipotesi", "no": "Hypotese", "es": "Hipótesis", "is": "Tilgáta",
    "bg": "Хипотеза", "sv": "Hypotes", "sl": "Hipoteza", "ms": "Hipotesis", "th": "สมมติฐาน",
    "pl": "Hipoteza", "ru": "Гипотеза", "de": "Hypothese", "fr": "Hypothèse", "nl": "Hypothese",
}
SENTENCE_FIELD = {
    "en": "Sentence", "zh": "句子", "ja": "文", "hi": "वाक्य", "sw": "Sentensi", "bn": "বাক্য",
    "it": "Frase", "no": "Setning", "es": "Sentencia", "is": "Setning", "bg": "Изречение",
    "sv": "Mening", "sl": "Stavek", "ms": "Ayat", "th": "ประโยค", "pl": "Zdanie",
    "ru": "Приговор", "de": "Satz", "fr": "Phrase", "nl": "Zin",
}
NLI_ANSWER_FIELD = {
    "en": "Answer", "zh": "答案", "ja": "答え", "hi": "उत्तर", "sw": "Jibu", "bn": "উত্তর",
    "it": "Risposta", "no": "Svar", "es": "Respuesta", "is": "Svaraðu", "bg": "Отговор",
    "sv": "Svar", "sl": "Odgovori", "ms": "Jawab", "th": "คำตอบ", "pl": "Odpowiedź",
    "ru": "Отвечать", "de": "Antwort", "fr": "Répondre", "nl": "Antwoord",
}
PAIR_ANSWER_FIELD = {**NLI_ANSWER_FIELD, "ru": "Ответить"}

# ---- our own demonstration sentences: (praise, complaint, plain fact) -------

DEMO_SENTENCES = {
    "en": ("This book is wonderful.", "This book is terrible.", "This book is new."),
    "zh": ("这本书很棒。", "这本书很糟糕。", "这本书是新的。"),
    "ja": ("この本は素晴らしい。", "この本はひどい。", "この本は新しい。"),
    "hi": ("यह किताब शानदार है।", "यह किताब बेकार है।", "यह किताब नई है।"),
    "sw": ("Kitabu hiki ni kizuri sana.", "Kitabu hiki ni kibaya sana.", "Kitabu hiki ni kipya."),
    "bn": ("এই বইটি চমৎকার।", "এই বইটি খুব খারাপ।", "এই বইটি নতুন।"),
    "it": ("Questo libro è meraviglioso.", "Questo libro è terribile.", "Questo libro è nuovo."),
    "no": ("Denne boken er fantastisk.", "Denne boken er forferdelig.", "Denne boken er ny."),
    "es": ("Este libro es maravilloso.", "Este libro es terrible.", "Este libro es nuevo."),
    "is": ("Þessi bók er frábær.", "Þessi bók er hræðileg.", "Þessi bók er ný."),
    "bg": ("Тази книга е чудесна.", "Тази книга е ужасна.", "Тази книга е нова."),
    "sv": ("Den här boken är underbar.", "Den här boken är hemsk.", "Den här boken är ny."),
    "sl": ("Ta knjiga je čudovita.", "Ta knjiga je grozna.", "Ta knjiga je nova."),
    "ms": ("Buku ini sangat bagus.", "Buku ini sangat teruk.", "Buku ini baharu."),
    "th": ("หนังสือเล่มนี้ดีมาก", "หนังสือเล่มนี้แย่มาก", "หนังสือเล่มนี้ใหม่"),
    "pl": ("Ta książka jest wspaniała.", "Ta książka jest okropna.", "Ta książka jest nowa."),
    "ru": ("Эта книга замечательная.", "Эта книга ужасная.", "Эта книга новая."),
    "de": ("Dieses Buch ist wunderbar.", "Dieses Buch ist schrecklich.", "Dieses Buch ist neu."),
    "fr": ("Ce livre est merveilleux.", "Ce livre est horrible.", "Ce livre est neuf."),
    "nl": ("Dit boek is prachtig.", "Dit boek is vreselijk.", "Dit boek is nieuw."),
}
_PRAISE, _COMPLAINT, _FACT = 0, 1, 2

# One demonstration is (sentence index, ..., class).
DEMO_SHOTS = {
    "sentiment": ((_PRAISE, "positive"), (_COMPLAINT, "negative")),
    "nli": (
        (_PRAISE, _PRAISE, "entailment"),
        (_PRAISE, _COMPLAINT, "contradiction"),
        (_PRAISE, _FACT, "neutral"),
        (_COMPLAINT, _COMPLAINT, "entailment"),
        (_COMPLAINT, _PRAISE, "contradiction"),
        (_COMPLAINT, _FACT, "neutral"),
    ),
    "pair": (
        (_PRAISE, _PRAISE, "same"),
        (_PRAISE, _COMPLAINT, "different"),
        (_FACT, _FACT, "same"),
        (_FACT, _COMPLAINT, "different"),
    ),
}

TASK_MODES = (
    ("sentiment", "native"),
    ("sentiment", "english"),
    ("sentiment", "unrelated"),
    ("nli", "native"),
    ("nli", "english"),
    ("pair", "english"),
)

# Languages the representation analysis prompts in.
REPRESENTATION_LANGUAGES = ("en", "zh", "hi", "de", "fr", "th", "sw", "ms")
# Languages it stacks, in stacking order, and the pairs it correlates.
STACK_LANGUAGES = ("en", "de", "fr", "hi", "th", "sw", "ms")
PEARSON_PAIRS = (
    ("en", "de"), ("en", "fr"), ("en", "hi"), ("de", "fr"), ("de", "hi"),
    ("fr", "hi"), ("en", "th"), ("en", "sw"), ("en", "ms"),
)


@dataclass(frozen=True)
class Run:
    """One entry of the model registry."""

    run_id: str
    model_uri: str
    family: str


def _native_words(task: str) -> dict[str, dict[str, str]]:
    """class -> language -> word, in the language of the item."""
    if task == "sentiment":
        return {"positive": SENTIMENT_POSITIVE, "negative": SENTIMENT_NEGATIVE}
    if task == "nli":
        return {
            "entailment": NLI_ENTAILMENT,
            "neutral": NLI_NEUTRAL,
            "contradiction": NLI_CONTRADICTION,
        }
    if task == "pair":
        return {
            "same": dict.fromkeys(LANGUAGES, PAIR_SAME),
            "different": dict.fromkeys(LANGUAGES, PAIR_DIFFERENT),
        }
    raise ValueError(f"unknown task {task!r}")


def _shown_words(task: str, label_mode: str) -> dict[str, dict[str, str]]:
    """class -> language -> the word the model is asked to produce."""
    native = _native_words(task)
    if label_mode == "native":
        return native
    if label_mode == "english":
        return {c: dict.fromkeys(LANGUAGES, words["en"]) for c, words in native.items()}
    if label_mode == "unrelated" and task == "sentiment":
        return {
            "positive": dict.fromkeys(LANGUAGES, UNRELATED_POSITIVE["en"]),
            "negative": dict.fromkeys(LANGUAGES, UNRELATED_NEGATIVE["en"]),
        }
    if label_mode == "unrelated_native" and task == "sentiment":
        return {"positive": UNRELATED_POSITIVE, "negative": UNRELATED_NEGATIVE}
    raise ValueError(f"no {label_mode!r} words for task {task!r}")


def answer_word_rows(task_modes=TASK_MODES) -> list[dict]:
    """Rows (task, label_mode, lang, class, word, gold_word)."""
    rows = []
    for task, mode in task_modes:
        gold = _native_words(task)
        for cls, by_lang in _shown_words(task, mode).items():
            for lang, word in by_lang.items():
                rows.append({
                    "task": task, "label_mode": mode, "lang": lang, "class": cls,
                    "word": word, "gold_word": gold[cls][lang],
                })
    return rows


def _fields(task: str, lang: str) -> tuple[str | None, str | None, str]:
    if task == "sentiment":
        return None, None, SENTIMENT_FIELD[lang]
    if task == "nli":
        return PREMISE_FIELD[lang], HYPOTHESIS_FIELD[lang], NLI_ANSWER_FIELD[lang]
    base = SENTENCE_FIELD[lang]
    return f"{base} 1", f"{base} 2", PAIR_ANSWER_FIELD[lang]


def _demo_block(task: str, lang: str, words: dict[str, dict[str, str]]) -> str:
    field1, field2, answer = _fields(task, lang)
    lines = []
    for *texts, cls in DEMO_SHOTS[task]:
        sentences = [DEMO_SENTENCES[lang][i] for i in texts]
        if field1 is None:
            lines.append(sentences[0])
        else:
            lines.append(f"{field1}: {sentences[0]}")
            lines.append(f"{field2}: {sentences[1]}")
        lines.append(f'{answer}: "{words[cls][lang]}"')
    return "\n".join(lines)


def locale_rows(task_modes=TASK_MODES) -> list[dict]:
    """Rows (task, label_mode, lang, n_shots, demo_block, field1, field2, answer_field)."""
    rows = []
    for task, mode in task_modes:
        words = _shown_words(task, mode)
        for lang in LANGUAGES:
            if any(lang not in by_lang for by_lang in words.values()):
                continue
            field1, field2, answer = _fields(task, lang)
            rows.append({
                "task": task, "label_mode": mode, "lang": lang,
                "n_shots": len(DEMO_SHOTS[task]),
                "demo_block": _demo_block(task, lang, words),
                "field1": field1, "field2": field2, "answer_field": answer,
            })
    return rows
