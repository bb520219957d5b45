"""Patterns, word lists and weights as data: every query takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

# Fixed values, begin: patterns, word lists and weights that results depend on.

LAUGH = r"(?i)(w{2,}|草+|www+|哈哈哈+|哈{2,}|笑死|太扯|幹哈|lol|lmao|777+)"
CONFUSED = r"(?i)([?？]{2,}|蛤+|什麼鬼|什麼東西|幹嘛|嚇死|崩潰)"
CLIP_CUE = r"(?i)(精華|剪輯師|剪輯|這段要剪|要剪|拜託剪|記得剪|剪進去|shorts?)"

MINING_PATTERNS = {
    "question_mark": r"[?？]",
    "multi_question": r"[?？]{2,}",
    "laugh": r"(?i)(w{2,}|草+|www+|哈哈哈+|哈{2,}|笑死|太扯|幹哈|lol|lmao)",
    "clip_cue": CLIP_CUE,
    "confusion": r"(蛤+|什麼鬼|什麼東西|幹嘛|嚇死|崩潰|阿\?|啊\?)",
}
MINING_TOKEN = r"(?i)([一-鿿]{2,8}|[?？]{1,}|w{2,}|草+)"

CJK = r"一-鿿"
SENTENCE_ENDS = ("。", "！", "？", "!", "?", "～", "~")
NOISE_ONLY = r"""^[\s.,!?？！。、；;：:\-~～…·・'"「」『』（）()\[\]【】]*$"""
SPLIT_PUNCT = "，,。.!！？?、；;：:… "
HARD_PUNCT = "。.!！？?"
LINE_START_PARTICLES = "嗎呢啊啦吧呀唷呦喔哦欸誒蛤嗯"
CONJUNCTIONS = ("但是", "然後", "所以", "因為", "可是", "而且", "不過", "如果")

OUTRO = (
    "晚安", "拜拜", "掰掰", "下班", "下班啦", "今天就到", "下播", "謝謝大家收看",
    "明天見", "下禮拜見", "結束直播", "今日到此",
)
INTRO = ("安安", "大家好", "歡迎", "問好", "初次見面", "今天來聊", "哈囉", "哈喽")

STOP_WORDS = (
    "的", "了", "嗎", "呢", "啊", "喔", "哦", "欸", "誒", "蛤", "吧", "啦", "呀", "唷", "呦",
    "喔喔", "欸欸", "哩勒", "呵呵", "嗯", "呃", "喔是", "哈哈", "哈哈哈", "草", "www",
    "？", "?", "！", "!", "，", ",", "。", ".", " ",
)
EXTRA_EMPHASIS = ("笑死", "爆笑")

TALK_TITLE_WORDS = ("雜談", "閒聊", "聊天", "聊心事", "radio", "雑談", "talk", "棉花糖", "心事")
GAME_TITLE_WORDS = (
    "minecraft", "valorant", "遊戲", "game", "apex", "lol", "原神", "zelda", "魔物獵人",
    "實況", "節奏天國", "節奏", "復健", "奇蹟之星", "玩",
)

CHAT_HINTS = {
    "cookies": "set_YTDLP_COOKIES_or_YTDLP_BROWSER=chrome",
    "runtime": "install_node_for_ytdlp_js",
    "review": "prefer_Cursor_review",
}

STEP_WEIGHTS = {
    "01_download": 8,
    "02_asr": 22,
    "03_highlights": 6,
    "04_edit": 18,
    "05_subtitle": 24,
    "06_effects": 8,
    "07_flourish": 7,
    "08_hook": 7,
}

TALK_WEIGHTS: dict[str, Any] = {
    "clip_min_sec": 45.0, "clip_max_sec": 60.0, "story_min_sec": 45.0, "story_max_sec": 85.0,
    "story_gap_max_sec": 20.0, "continuity_min": 0.5, "speech_ratio_min": 0.45,
    "outro_penalty": 0.15, "intro_penalty": 0.15,
    "w_chat": 2.0, "w_vol": 0.8, "w_kw": 1.4, "w_emotion": 1.0,
    "w_chat_react": 1.6, "w_chat_kw": 1.2, "w_clip_cue": 2.5,
    "chat_weak_vol_scale": 0.55, "chat_weak_kw_scale": 1.35, "chat_weak_emotion_scale": 1.25,
    "outro_keywords": OUTRO,
    "intro_keywords": INTRO,
    "keywords": ("笑死", "太扯", "完蛋", "哭啊", "欸欸", "哩勒", "幹嘛", "蛤", "爆笑"),
    "flourish_keywords": ("笑死", "太扯", "完蛋", "哭啊", "幹嘛", "爆笑"),
    "chat_keywords": ("草", "www", "笑死", "777", "哈哈哈", "太扯", "LOL", "爆笑", "精華", "剪輯師"),
}
GAME_WEIGHTS: dict[str, Any] = {
    "clip_min_sec": 40.0, "clip_max_sec": 60.0, "story_min_sec": 45.0, "story_max_sec": 100.0,
    "story_gap_max_sec": 22.0, "continuity_min": 0.48, "speech_ratio_min": 0.40,
    "outro_penalty": 0.35, "intro_penalty": 0.35,
    "w_chat": 1.4, "w_vol": 1.1, "w_kw": 1.4, "w_emotion": 1.5,
    "w_chat_react": 1.4, "w_chat_kw": 1.1, "w_clip_cue": 2.5,
    "chat_weak_vol_scale": 0.5, "chat_weak_kw_scale": 1.4, "chat_weak_emotion_scale": 1.3,
    "outro_keywords": ("晚安", "拜拜", "下班", "下播", "謝謝大家收看", "明天見"),
    "intro_keywords": ("安安", "大家好", "歡迎", "問好", "哈囉"),
    "keywords": (
        "完了", "完蛋", "死了", "殺了", "贏了", "輸了", "太扯", "尖叫", "GG", "clutch", "笑死",
    ),
    "flourish_keywords": (
        "完了", "完蛋", "死了", "殺了", "贏了", "輸了", "太扯", "尖叫", "GG", "clutch", "笑死",
    ),
    "chat_keywords": ("草", "www", "笑死", "777", "哈哈哈", "太扯", "GG", "精華", "剪輯師", "LOL"),
}


@dataclass(frozen=True)
class Profile:
    """Weights and word lists of one content type."""

    content_type: str = "talk"
    clip_min_sec: float = 45.0
    clip_max_sec: float = 60.0
    story_min_sec: float = 45.0
    story_max_sec: float = 90.0
    story_gap_max_sec: float = 25.0
    continuity_min: float = 0.5
    prefilter_top_n: int = 20
    clips_per_hour: int = 4
    window_step_sec: float = 15.0
    bucket_slide_cap: int | None = None  # slides of an hour, from its start; None: all
    seed_dedupe_sec: float = 8.0
    short_window_sec: float = 45.0
    diversity_min_gap_sec: float = 90.0
    speech_ratio_min: float = 0.45
    outro_penalty: float = 0.15
    intro_penalty: float = 0.15
    chat_lag_sec: float = 8.0
    w_chat: float = 1.0
    w_vol: float = 1.2
    w_kw: float = 1.5
    w_emotion: float = 0.8
    w_chat_react: float = 1.2
    w_chat_kw: float = 1.0
    w_clip_cue: float = 2.0
    chat_weak_vol_scale: float = 0.55
    chat_weak_kw_scale: float = 1.35
    chat_weak_emotion_scale: float = 1.25
    keywords: tuple[str, ...] = ()
    chat_keywords: tuple[str, ...] = ()
    flourish_keywords: tuple[str, ...] = ()
    outro_keywords: tuple[str, ...] = ()
    intro_keywords: tuple[str, ...] = ()
    laugh: str = LAUGH
    confused: str = CONFUSED
    clip_cue: str = CLIP_CUE
    sentence_ends: tuple[str, ...] = field(default=SENTENCE_ENDS)
    # Fixed values, end.

    def with_(self, **changes: Any) -> "Profile":
        return replace(self, **changes)

    def emphasis_keywords(self) -> list[str]:
        """Listed emphasis words, else the scoring words, plus the two extras; content words only."""
        from clipmine.functions.text import keep_content_words

        words = list(self.flourish_keywords or self.keywords)
        return keep_content_words(words + [w for w in EXTRA_EMPHASIS if w not in words])


def profile_from_mapping(content_type: str, mapping: dict[str, Any]) -> Profile:
    known = {f.name for f in fields(Profile)}
    values: dict[str, Any] = {}
    for key, value in mapping.items():
        if key not in known or value is None:
            continue
        values[key] = tuple(str(v) for v in value) if isinstance(value, (list, tuple)) else value
    return Profile(content_type=content_type, **values)


TALK = profile_from_mapping("talk", TALK_WEIGHTS)
GAME = profile_from_mapping("game", GAME_WEIGHTS)
PROFILES = {"talk": TALK, "game": GAME}


def load_profile(path: str | Path, content_type: str) -> Profile:
    """Read one weights file (YAML)."""
    import yaml

    return profile_from_mapping(content_type, yaml.safe_load(Path(path).read_text("utf-8")) or {})
