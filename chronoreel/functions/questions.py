"""Question class, query intent and player commands by cue words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue patterns in order of precedence, and weights.
QUESTION_RULES = (
    ("CurrentFrame", "(当前|现在|这一帧|眼前|画面里现在)"),
    ("TemporalLocalization", "(什么时候|何时|多少秒|哪一段|哪个时间点|第几分钟)"),
    ("Counting", "(几个|多少个|几次|多少次|出现了几)"),
    ("CausalReasoning", "(为什么|为何|是因为|导致|原因)"),
    ("Counterfactual", "(如果|假如|要是)"),
    ("Comparison", "(区别|不同|对比|相比)"),
    ("TemporalOrder", "(之前|之后|先|后|顺序)"),
    ("Duration", "(持续|多久|多长时间)"),
    ("EntityQuery", "(那个|谁|什么人|穿|戴|是谁)"),
    ("SpatialQuery", "(左边|右边|上面|下面|角落|画面.*角)"),
    ("ActionRecognition", "(在做什么|干什么|动作)"),
    ("GlobalSummary", "(讲什么|讲了什么|大意|总结|概括|主题)"),
    ("DetailDescription", "(详细描述|具体描述|细节)"),
)
VISUAL_CUES = "(画面|颜色|穿着|红色|蓝色|绿色|黄色|白色|黑色|衣服|图案|左|右|上|下|物体|画面里|镜头|背景|人[^名字]|车|建筑)"
TEXT_CUES = "(说|讲|台词|对话|字幕|讨论|提到|口播|朗读|发言|转写)"
ENTITY_CUES = "(那个|这个|刚才的|开头的|结尾的|之前的|视频里的.*[人|物])"
VISUAL_ONLY = "(穿|衣服|颜色|长什么样|画面里有|画面中有|左上|右上|左下|右下|背景里|几个人|多少人|表情|手里拿)"
AUDIO_ONLY = "(说了什么|谁说|台词|对白|对话|字幕|提到|讲了|原话|口播|旁白|解说|念)"
NARRATIVE = "(发生了什么|讲了什么|剧情|为什么|怎么回事|经过|起因|总结|概括|这一段|这段)"
PLAYER_WORDS = r"(seek|跳转|跳到|播放|暂停|play|pause|快进|快退|定位|跳|go\s*to|jump\s*to)"
WEIGHTS_VISUAL, WEIGHTS_TEXT, WEIGHTS_BOTH = (0.2, 0.7, 0.1), (0.7, 0.2, 0.1), (0.4, 0.4, 0.2)

#: A word boundary of ASCII letters, digits and underscore alone, whatever the dialect's own.
PLAYER_PATTERN = rf"(?i)((?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])){PLAYER_WORDS}((?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def question_class(q: Column) -> Column:
    """The first rule that matches, else Unknown."""
    out = F.lit("Unknown")
    for name, pattern in reversed(QUESTION_RULES):
        out = F.when(q.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def intent(q: Column) -> dict[str, Column]:
    """Flags, path weights (text, visual, entity) and evidence preferences of a question."""
    visual = q.rlike(VISUAL_CUES)
    text = q.rlike(TEXT_CUES) | ~visual
    by = lambda i: F.when(visual & ~text, F.lit(WEIGHTS_VISUAL[i])).when(~visual & text, F.lit(WEIGHTS_TEXT[i])).otherwise(F.lit(WEIGHTS_BOTH[i]))
    sees, hears = q.rlike(VISUAL_ONLY), q.rlike(AUDIO_ONLY)
    prefers_visual, prefers_audio = sees & ~hears, hears & ~sees
    return {
        "needs_text": text,
        "needs_visual": visual,
        "has_entity": q.rlike(ENTITY_CUES),
        "w_text": by(0),
        "w_visual": by(1),
        "w_entity": by(2),
        "prefers_visual": prefers_visual,
        "prefers_audio": prefers_audio,
        "prefers_fused": q.rlike(NARRATIVE) | (~prefers_visual & ~prefers_audio),
    }


def is_player_command(q: Column) -> Column:
    return q.rlike(PLAYER_PATTERN)


def evidence_weight(chunk_type: Column, visual: Column, audio: Column, fused: Column) -> Column:
    """Multiplier of a text hit by its chunk type (name) and the question's preferences."""
    return (
        F.when(chunk_type == "SceneSummary", F.when(visual, 1.15).when(audio, 0.75).otherwise(1.0))
        .when(chunk_type == "SceneAudio", F.when(audio, 1.15).when(visual, 0.70).otherwise(0.95))
        .when(chunk_type == "SpeechSegment", F.when(audio, 1.20).when(visual, 0.70).otherwise(1.0))
        .when(chunk_type == "SceneFused", F.when(fused, 1.10).otherwise(1.0))
        .otherwise(F.lit(1.0))
    )
