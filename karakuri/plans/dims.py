"""Fixed dictionaries of the engine, as Python constants, small DataFrames and SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The inspection checklist: group, item, category shown, spoken aliases.
CHECKLIST = [
    ("油脂・エンジン関連", "engine_oil", "エンジンオイル", "エンジンオイル"),
    ("油脂・エンジン関連", "oil_element", "オイルエレメント", "オイルエレメント オイルフィルター"),
    ("油脂・エンジン関連", "air_element", "エアーエレメント", "エアエレメント エアクリーナーエレメント エアクリーナー エアーエレメント"),
    ("油脂・エンジン関連", "power_steering_oil", "パワステオイル", "パワステオイル パワーステアリングオイル 合わせてオイル ファーストオイル パワーステオイル"),
    ("油脂・エンジン関連", "coolant", "クーラント", "クーラント 冷却水 空欄と 空欄ト クーランド"),
    ("油脂・エンジン関連", "accessory_belt", "補機ベルト", "補機ベルト ファンベルト エアコンベルト 補器ベルト ホキベルト ほきベルト"),
    ("油脂・エンジン関連", "timing_belt", "タイミングベルト", "タイミングベルト"),
    ("油脂・エンジン関連", "spark_plug", "スパークプラグ", "スパークプラグ"),
    ("油脂・エンジン関連", "battery", "バッテリー", "バッテリー"),
    ("油脂・エンジン関連", "brake_fluid", "ブレーキフルード", "ブレーキフルード"),
    ("油脂・エンジン関連", "mission_oil", "ミッションオイル", "ミッションオイル"),
    ("油脂・エンジン関連", "transfer_oil", "トランスファーオイル", "トランスファーオイル"),
    ("油脂・エンジン関連", "diff_oil", "デフオイル", "デフオイル デファレンシャルオイル"),
    ("油脂・エンジン関連", "ac_filter", "エアコンフィルター", "エアコンフィルター コンフィルター エアコンフィルタ エアコンフイルター エアコンフィルダー"),
    ("ブレーキ・足回り", "driveshaft_boot", "ドライブシャフトブーツ", "ドライブシャフトブーツ ドライブシャフト"),
    ("ブレーキ・足回り", "steering_boot", "ステアリングブーツ", "ステアリングブーツ"),
    ("ブレーキ・足回り", "lower_boot", "ロアブーツ", "ロアブーツ ロアアームブーツ ロワブーツ ロアーブール ロワーブーツ"),
    ("ブレーキ・足回り", "tie_rod_end_boot", "タイロッドエンドブーツ", "タイロッドエンドブーツ タイロットエンドブーツ タイロッドエンドブース タイロットエンドブース タイロッドエンドブート タイロットエンドブート タイロッドエンド"),
    ("ブレーキ・足回り", "stabilizer_link_boot", "スタビリンクブーツ", "スタビリンクブーツ スタビライザーリンクブーツ"),
    ("ブレーキ・足回り", "brake_pad_front", "フロントブレーキパッド", "フロントブレーキパッド Fブレーキパッド 前ブレーキパッド"),
    ("ブレーキ・足回り", "brake_pad_rear", "リヤブレーキパッド/ライニング", "リアブレーキパッド Rブレーキパッド 後ろブレーキパッド リヤブレーキパッド ブレーキライニング ライニング"),
    ("タイヤ・車体", "tire_front", "フロントタイヤ残量", "フロントタイヤ残量 フロントタイヤ 前タイヤ"),
    ("タイヤ・車体", "tire_rear", "リヤタイヤ残量", "リヤタイヤ残量 リヤタイヤ リアタイヤ残量 リアタイヤ 後ろタイヤ"),
    ("タイヤ・車体", "tire_overhang", "タイヤはみ出し", "タイヤはみ出し はみ出し"),
    ("タイヤ・車体", "ground_clearance", "最低地上高", "最低地上高 車高 最低地条項"),
    ("保安・車検関連", "shift_indicator", "シフト表示", "シフト表示"),
    ("保安・車検関連", "electrical", "電気回り", "電気回り 電装 ストップランプ ブレーキランプ テールランプ ウインカー ウィンカー ヘッドライト ヘッドランプ スモールランプ バックランプ ナンバー灯 ライセンスランプ"),
    ("保安・車検関連", "wiper_blade", "ワイパーゴム", "ワイパーゴム ワイパー"),
    ("保安・車検関連", "catalyst", "触媒", "触媒 マフラー触媒"),
    ("保安・車検関連", "seatbelt_warning", "シートベルト警告灯", "シートベルト警告灯 シートベルトランプ"),
    ("保安・車検関連", "flare", "発煙筒", "発煙筒"),
    ("保安・車検関連", "window_operation", "ウインドウ作動", "ウインドウ作動 パワーウインドウ"),
    ("保安・車検関連", "co_hc", "CO・HC", "CO HC"),
]
# Words that state a judgement, by status.
JUDGEMENTS = [
    ("ng", "不合格 アウト ダメ 車検NG NG エヌジー"),
    ("replace_strong", "交換推奨 交換必要 要交換 交換"),
    ("recommend", "おすすめ オススメ お勧め 推奨"),
    ("na", "該当なし 付いていない 付いてない なし"),
    ("good", "問題なし オーケー オッケー 良好 OK"),
    ("customer_request", "お客様要望 お客さん要望 依頼あり ご要望 要望"),
    ("customer_declined", "不要とのこと お客様不要 お客さん不要 いらない やらない 不要"),
    ("maintenance", "整備"),
]
# Position words, by axis.
POSITIONS = {
    "fr": [("front", "フロント"), ("rear", "リア"), ("rear", "リヤ"), ("front", "前"), ("rear", "後ろ")],
    "lr": [("right", "右"), ("left", "左")],
    "io": [("inner", "インナー"), ("outer", "アウター")],
}
# Statuses in the order of the user interface, with label and colour class.
STATUSES = [
    ("ng", "不合格", "status-ng"), ("replace_strong", "要交換", "status-replace"), ("recommend", "おすすめ", "status-recommend"),
    ("maintenance", "整備", "status-maintenance"), ("customer_request", "ご要望", "status-request"), ("customer_declined", "お客様不要", "status-declined"),
    ("na", "該当なし", "status-na"), ("good", "良好", "status-good"), ("unset", "未確認", "status-unset"),
]
#: Statuses that the memo reports, in its order.
PROBLEMS = [s for s, _, _ in STATUSES[:6]]
# Names of lamps that are themselves the defect.
DESCRIPTIVE = "ストップランプ ブレーキランプ テールランプ ウインカー ウィンカー ヘッドライト ヘッドランプ スモールランプ バックランプ ナンバー灯 ライセンスランプ".split()
# Recogniser errors and their messages; the first list of codes lets listening go on.
CONTINUES = ["no-speech"]
VOICE_ERRORS = [
    ("not-allowed", "マイク/音声認識の許可が拒否されています"), ("service-not-allowed", "音声認識サービスが許可されていません"), ("audio-capture", "マイクを取得できません"),
    ("network", "音声認識サービスへの通信に失敗しました"), ("no-speech", "音声が検出されませんでした"), ("aborted", "音声認識が中断されました"),
]
VOICE_STATES = [
    ("idle", "音声入力停止中"), ("listening", "認識中…"), ("processing", "解析中…"), ("error", "認識失敗（下のエラー内容を確認してください）"), ("unsupported", "この端末では音声入力を利用できません"),
]
APP_EVENTS = ["inspection_start", "microphone_start", "speech_recognition_success", "unrecognized_input", "summary_view", "back_to_top"]

#: White space: what a session in the browser takes for it.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E]))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)
_FOLD = str.maketrans(WIDE + HIRAGANA, NARROW + KATAKANA)


def folded(text: str) -> str:
    """The form that words are compared in."""
    return "".join(c.translate(_FOLD).upper().translate(_FOLD) for c in text if c not in WHITE)


def ranked(rows: list[tuple[str, str]]) -> list[tuple[int, str, str, int]]:
    """(rank, value, folded alias, length): longest first, else as listed; an alias that recurs keeps its first rank."""
    out: dict[str, tuple[str, str]] = {}
    for value, alias in rows:
        out.setdefault(folded(alias), (value, folded(alias)))
    order = sorted(out.values(), key=lambda r: -len(r[1]))
    return [(k, value, alias, len(alias)) for k, (value, alias) in enumerate(order)]


ALIASES = ranked([(item, a) for _, item, _, names in CHECKLIST for a in names.split()])
RANKED_JUDGEMENTS = ranked([(status, a) for status, names in JUDGEMENTS for a in names.split()])
RANKED_POSITIONS = {axis: ranked(rows) for axis, rows in POSITIONS.items()}
SOURCE_JUDGEMENTS = [folded(a) for _, names in JUDGEMENTS for a in names.split()]


def fuzzy_limit(n: int) -> int:
    """Characters that may differ in a window of an alias of n characters."""
    return 0 if n < 3 else 1 if n < 8 else 2


def approx_limit(n: int) -> int:
    """Edits between a whole segment and an alias of n characters."""
    return 0 if n < 5 else 1 if n <= 7 else 2 if n <= 11 else 3


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def checklist_dim(spark: SparkSession) -> DataFrame:
    return frame(spark, [(k, item, name, group) for k, (group, item, name, _) in enumerate(CHECKLIST)], "ord int, item_id string, category string, `group` string")


def status_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, label, k, PROBLEMS.index(s) if s in PROBLEMS else None, css) for k, (s, label, css) in enumerate(STATUSES)]
    return frame(spark, rows, "status string, label string, ui_ord int, summary_ord int, css string")


def values(rows, columns: str) -> str:
    """The rows as an SQL table expression."""
    def said(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({columns}))"
