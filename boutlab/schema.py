"""Column names, domains and fixed values shared by every job."""

from __future__ import annotations

CORNERS = ("r", "b")

AREAS = ("sig_str", "head", "body", "legs", "distance", "clinch", "ground", "total_str", "td")
MAX_ROUNDS = 5
ROUND_AREAS = tuple(f"round_{n}_sig_str" for n in range(1, MAX_ROUNDS + 1))
CATEGORIES = AREAS + ROUND_AREAS

ROUND_SECONDS = 300


def _spread(categories, suffixes):
    return [f"{c}_{s}" for c in categories for s in suffixes]


# What one corner did in one bout.
STAT_COLUMNS = _spread(CATEGORIES, ("landed", "attempted")) + [
    "kd_landed", "subs_attempted", "ctrl_time", "reversals",
]

_FOUR = ("landed", "attempted", "absorbed", "evaded")
RECORD = ["wins", "losses", "draws"]
STRIKES = _spread(CATEGORIES, _FOUR)
CONTROL = ["ctrl_time", "opponent_ctrl_time"]
KNOCKDOWNS = ["kd_landed", "kd_absorbed"]
SUBMISSIONS = ["subs_attempted", "subs_evaded"]
# Sums over a competitor's bouts of what the opponent had before each bout.
OPPONENT_BEFORE = {
    "opponent_wins": "wins",
    "opponent_loses": "losses",
    "opponent_fight_time": "fight_time",
}

# Career totals in the order of a model row; `age`, `stance`, `height` and
# `reach` are attributes, not sums.
CORNER_FEATURES = (
    ["age"] + RECORD + ["stance", "height", "reach"]
    + ["opponent_wins", "opponent_loses", "championship_fights"]
    + _spread(AREAS, _FOUR) + KNOCKDOWNS + SUBMISSIONS + CONTROL
    + _spread(ROUND_AREAS, _FOUR)
    + ["fight_time", "opponent_fight_time", "reversals"]
)
ATTRIBUTES = ("age", "stance", "height", "reach")
TOTAL_COLUMNS = [c for c in CORNER_FEATURES if c not in ATTRIBUTES]

FEATURES = ["weight", "gender"] + [f"{side}_{c}" for side in CORNERS for c in CORNER_FEATURES]
TEXT_FEATURES = ("gender", "r_stance", "b_stance")

# Domains of the text features.
GENDERS = ("female", "male")
STANCES = ("Open Stance", "Orthodox", "Sideways", "Southpaw", "Switch")
VOCABULARY = {"gender": GENDERS, "r_stance": STANCES, "b_stance": STANCES}

LABELS = ("Red", "Blue", "DRAW")

# Weight class to pounds.
WEIGHT_CLASSES = {
    "strawweight": 115,
    "flyweight": 125,
    "bantamweight": 135,
    "featherweight": 145,
    "lightweight": 155,
    "welterweight": 170,
    "middleweight": 185,
    "light heavyweight": 205,
    "heavyweight": 265,
    "catch weight": 140,
}

# Spelling used by the odds pages to spelling used by the bout pages.
NAME_ALIASES = {
    "Khalil Rountree": "Khalil Rountree Jr.",
    "Benoit Saint-Denis": "Benoit Saint Denis",
    "Thiago Moisés": "Thiago Moises",
    "Kenan Song": "Song Kenan",
    "Na Liang": "Liang Na",
    "Seung Woo Choi": "SeungWoo Choi",
    "Weili Zhang": "Zhang Weili",
    "Rafael dos Anjos": "Rafael Dos Anjos",
    "Montserrat Ruiz": "Montserrat Conejo Ruiz",
    "Asu Almabaev": "Assu Almabayev",
    "Caolán Loughran": "Caolan Loughran",
    "Łukasz Brzeski": "Lukasz Brzeski",
    "Michał Oleksiejczuk": "Michal Oleksiejczuk",
    "Natália Silva": "Natalia Silva",
    "Jéssica Andrade": "Jessica Andrade",
    "Ľudovít Klein": "Ludovit Klein",
    "Diana Belbiţă": "Diana Belbita",
    "Mateus Mendonça": "Mateus Mendonca",
    "Johnny Munoz Jr.": "Johnny Munoz",
    "Mizuki Inoue": "Mizuki",
    "Lupita Godinez": "Loopy Godinez",
    "Edgar Cháirez": "Edgar Chairez",
    "Da Un Jung": "Da Woon Jung",
    "Landon Quiñones": "Landon Quinones",
    "Mike Mathetha": "Blood Diamond",
    "Hyun Sung Park": "HyunSung Park",
    "Jun Yong Park": "JunYong Park",
    "André Muniz": "Andre Muniz",
    "Yadong Song": "Song Yadong",
    "Lucie Pudilová": "Lucie Pudilova",
    "Jiří Procházka": "Jiri Prochazka",
    "Mateusz Rębecki": "Mateusz Rebecki",
    "John Castañeda": "John Castaneda",
    "Elizeu Zaleski": "Elizeu Zaleski dos Santos",
    "Kauê Fernandes": "Kaue Fernandes",
    "Victoria Dudakova": "Viktoriia Dudakova",
}

# Fixed value: a name two different competitors share, exempt from deduplication.
SHARED_NAMES = ("Bruno Silva",)
