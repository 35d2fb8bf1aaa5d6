"""Policies as data: word lists, patterns, weights and caps. Every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Russian pronouns that are never entities.
PRONOUNS = (
    "я мы ты вы он она оно они меня нас тебя вас его её их мне нам тебе вам ему ей им мной мною нами тобой тобою вами "
    "нём ней них этой этом этому эту этим этот эта это эти какой какая какое какие кто что кого чего кому чему кем чем ком чём "
    "весь вся всё все сам сама само сами мой моя моё мои твой твоя твоё твои наш наша наше наши ваш ваша ваше ваши свой своя своё свои"
).split()

# Words that are never keywords.
STOPWORDS = (
    "что как так вот уже еще ещё был была было были the and but for with from this that have has had "
    "was were been being are is about just into она оно они него неё них всегда часто обычно постоянно никогда"
).split()

# Cue groups of relationship states, and query wordings that ask for a status.
RELATIONSHIP_CUES = {
    "conflict": [r"\bзл\w*", r"\bссор\w*", r"\bконфликт\w*", r"\bруг\w*", r"\bспор\w*", r"\bсорвал\w*"],
    "repair": [r"\bпомир\w*", r"\bпримир\w*", r"\bналад\w*"],
    "trust": [r"\bдовер\w*", r"\bполага\w*"],
    "distance": [r"\bнапряж\w*", r"\bдистанц\w*", r"\bосторож\w*", r"\bне до конца\b", r"\bне расслаб\w*"],
    "together": [r"\bсотруднич\w*", r"\bработа\w* вместе\b", r"\bснова работа\w* вместе\b", r"\bпомога\w*", r"\bвместе\b"],
    "attitude": [r"\bотнос\w*", r"\bотношен\w*", r"\bмежду ними\b"],
    "status": [
        r"\bчто у (?:них|неё|нее|него) сейчас\b",
        r"\bчто у них вообще\b",
        r"\bкак .* относ\w*",
        r"\bчто между ними\b",
        r"\bони уже .* или нет\b",
        r"\bони снова .*вместе\b",
    ],
}

# Queries for one scene, and markers of a scene's outcome.
SCENE_QUERY = [
    r"\bчто .* реш\w*",
    r"\bчто .* сказа\w*",
    r"\bна что .* договор\w*",
    r"\bчто произош\w*",
    r"\bчто было .* встреч\w*",
    r"\bпосле разговор\w*",
    r"\bвчера\b",
    r"\bутром\b",
]
SCENE_DETAIL = [
    r"\bреш\w*", r"\bсказа\w*", r"\bдоговор\w*", r"\bперенес\w*", r"\bпозва\w*", r"\bобсуд\w*",
    r"\bвстреч\w*", r"\bразговор\w*", r"\bутр\w*", r"\bвчера\b", r"\bпозже\b", r"\bсегодня\b",
]

# Lasting relationship states, and wordings that mark a mere episode.
DURABLE_STATES = {
    "trust": [r"\bснова довер\w*", r"\bбольше не довер\w*", r"\bдовер\w* .*в работ\w*", r"\bдовер\w* .*снова\b"],
    "distance": [
        r"\bдерж\w* дистанц\w*",
        r"\bосторож\w*",
        r"\bмежду ними .*напряж\w*",
        r"\bнапряж\w* .*между ними\b",
        r"\bвсё ещё .*напряж\w*",
        r"\bне до конца расслаб\w*",
    ],
    "repair": [r"\bчастич\w* помир\w*", r"\bпомир\w*", r"\bпримир\w*", r"\bне в открытой ссоре\b", r"\bне возвращать\w*.*ссор\w*"],
    "support": [
        r"\bподдерж\w* .*при всей команд\w*",
        r"\bподдерж\w* .*в работ\w*",
        r"\bне собира\w* .*оставля\w* .*одн\w*",
        r"\bприкрыл\w*",
        r"\bпомога\w* .*с фильм\w*",
    ],
    "cooperation": [
        r"\bснова работа\w* вместе\b",
        r"\bснова сотруднич\w*",
        r"\bсоглас\w* снова работать\b",
        r"\bдерж\w* друг друга в курсе\b",
        r"\bработа\w* спокойн\w*",
        r"\bснова поддерж\w* план\b",
    ],
}
EPISODE_BLOCKERS = [r"\bначал\w* ссор\w*", r"\bначал\w* спор\w*", r"\bсорвал\w* на\b", r"\bпоссор\w*", r"\bспор\w* на встреч\w*", r"\bвстрет\w* .*вчера\b"]
QUESTION_PREFIXES = [
    r"^\s*(?:что|как|когда|где|почему|зачем|кто|кого|кому|чего|чему)\b",
    r"^\s*(?:был|была|было|были|есть|ли)\b",
    r"^\s*они\b",
]

# Markers (found anywhere in the lower-cased text) and patterns of the memory types.
PREFERENCE = [
    "мне нравится", "люблю", "обожаю", "предпочитаю", "предпочитает", "любимый", "любимая", "ненавижу", "не люблю", "интересуюсь", "интересуется",
    "i like", "i love", "my favorite", "interested in",
]
PREFERENCE_PATTERNS = [r"\b(?:i|you|we|they|he|she)\s+(?:like|likes|love|loves|prefer|prefers|enjoy|enjoys|hate|hates)\b"]
PREFERENCE_PATTERNS_CASED = [r"\b[A-Z][a-z'-]+\s+(?:likes|loves|prefers|enjoys|hates)\b"]
PROFILE = ["владеет", "говорит на", "is from", "works as", "works at", "studies at", "lives in", "born in"]
PROFILE_PATTERNS = [
    r"\bработает [а-яё-]+(?:ом|ем)\b",
    r"\bживет в [а-яё][а-яё\s-]{1,30}\b|\bживёт в [а-яё][а-яё\s-]{1,30}\b",
    r"\bродом из [а-яё][а-яё\s-]{1,30}\b",
    r"\bучится(?: в [а-яё][а-яё\s-]{1,30})?\b",
    r"\b(?:[а-яё][а-яё-]+)\s+(?:врач|доктор|учитель|студент|программист)\b",
    r"\b(?:зеленые|зелёные|карие|голубые) глаза\b",
    r"\bвладеет\b",
    r"\bis (?:a|an) [a-z][a-z\s-]{0,30}\b",
    r"\bis from [a-z][a-z\s-]{1,30}\b",
    r"\blives in [a-z][a-z\s-]{1,30}\b",
    r"\bworks as [a-z][a-z\s-]{1,30}\b",
    r"\bhas [a-z\s-]{0,20}(eyes|hair|accent)\b",
    r"\b(?:i|you|we|they|he|she|[a-z][a-z'-]+)\s+owns [a-z][a-z\s-]{1,30}\b",
    r"\b(?:i|you|we|they|he|she|[a-z][a-z'-]+)\s+speaks [a-z][a-z\s-]{1,30}\b",
]
RELATIONSHIP = [
    "доверяю", "доверяет", "доверял", "доверяла", "забочусь", "заботится", "друг", "подруга", "брат", "сестра", "муж", "жена", "коллега",
    "встречается", "женат", "замужем", "отношени", "напряжени", "дистанци", "осторож", "поддерж", "сотруднич", "помир",
    "trust", "trusts", "care about", "cares about", "friend", "brother", "sister", "husband", "wife", "colleague", "dating", "married", "relationship",
]
TEMPORAL = [
    "вчера", "сегодня", "завтра", "утром", "вечером", "ночью", "позже",
    "yesterday", "today", "tomorrow", "this morning", "this evening", "tonight", "later",
]
EVENT = [
    "обсуждали", "решили", "пошли", "встретил", "встретила", "встретились", "сказал", "сказала", "поехал", "поехала", "поехали", "сделал", "сделала",
    "сделали", "запланировал", "запланировала", "договорились", "поссорились", "спорили", "ругались", "сорвался", "сорвалась", "началась",
    "discussed", "decided", "went", "met", "said", "told", "did", "planned", "argued", "fought", "visited", "called", "booked",
]
PLANS = ["хочу ", "хочет ", "буду ", "собираюсь ", "want to ", "wants to ", "will ", "going to "]
CONFLICT = ["conflict", "argue", "fight", "quarrel", "конфликт", "спор", "ссора", "руг"]

# Contents that are never worth storing.
LOW_VALUE = [
    "ok", "okay", "yes", "yeah", "yep", "no", "nope", "i understand", "understood", "got it", "we talked",
    "мы говорили", "понял", "поняла", "понятно", "хорошо", "ладно", "да", "нет",
]

# Word stems that choose a summary's segments.
SUMMARY_RELATIONSHIP = ["довер", "ссор", "спор", "руг", "помир", "отношен", "обещ"]
SUMMARY_GOALS = ["хочет", "хочу", "план", "собира", "цель", "решил", "решила", "договор", "поед", "сдела", "боит", "тревож", "устал", "злит", "важно", "переж"]


@dataclass(frozen=True)
class ExtractPolicy:
    """What makes a message a memory, and of which type."""

    preference: list[str] = field(default_factory=lambda: PREFERENCE)
    preference_patterns: list[str] = field(default_factory=lambda: PREFERENCE_PATTERNS)
    preference_patterns_cased: list[str] = field(default_factory=lambda: PREFERENCE_PATTERNS_CASED)
    profile: list[str] = field(default_factory=lambda: PROFILE)
    profile_patterns: list[str] = field(default_factory=lambda: PROFILE_PATTERNS)
    relationship: list[str] = field(default_factory=lambda: RELATIONSHIP)
    temporal: list[str] = field(default_factory=lambda: TEMPORAL)
    event: list[str] = field(default_factory=lambda: EVENT)
    plans: list[str] = field(default_factory=lambda: PLANS)
    conflict: list[str] = field(default_factory=lambda: CONFLICT)
    min_length: int = 10
    max_length: int = 500
    per_request: int = 3
    importance: dict[str, float] = field(default_factory=lambda: {"profile": 0.7, "relationship": 0.8, "event": 0.6})


@dataclass(frozen=True)
class GatePolicy:
    low_value: list[str] = field(default_factory=lambda: LOW_VALUE)
    min_length: int = 12
    min_words: int = 3
    min_keywords: int = 2
    min_entities: int = 1
    rich_words: int = 5


@dataclass(frozen=True)
class MergePolicy:
    exact_boost: float = 0.05
    soft_boost: float = 0.03
    longer_by: int = 10
    min_entities: int = 1
    min_keywords: int = 2
    newest: int | None = 200
    #: Slices of time in which soft matches are looked for, the newest first.
    slices: int = 3
    preserve_metadata: bool = False


@dataclass(frozen=True)
class ScorePolicy:
    keyword: float = 0.50
    entity: float = 0.25
    cue: float = 0.14
    both: float = 0.10
    importance: float = 0.12
    recency: float = 0.03
    pinned: float = 0.05
    support: dict[str, float] = field(default_factory=lambda: {"summary": 0.03, "stable": 0.03, "episodic": 0.015})
    specificity: float = 0.06
    low_value: float = 0.12
    detail: float = 0.45
    echo: float = 0.85
    threshold: float = 0.15
    similar: float = 0.80
    band: float = 0.05
    caps: dict[str, int] = field(default_factory=lambda: {"summary": 1, "stable": 2, "episodic": 2})
    keywords: int = 8
    entities: int = 10


@dataclass(frozen=True)
class BudgetPolicy:
    items: int = 4
    chars: int = 520
    caps: dict[str, int] = field(default_factory=lambda: {"summary": 1, "stable": 2, "episodic": 1})
    line: int = 110


@dataclass(frozen=True)
class SummaryPolicy:
    window: int = 8
    min_inputs: int = 3
    min_new: int = 3
    newest: int | None = 50
    kind: str = "rolling_v1"
    segments: int = 3
