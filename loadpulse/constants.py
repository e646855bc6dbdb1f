"""Fixed values.

Everything in this file is a value that results depend on: thresholds, label
lists, seed rows of the workload's dimension tables, load patterns and curve
tables.  There is no logic here.
"""

# --- series gate -----------------------------------------------------------
MINIMUM_ROWS = 40
MINIMUM_SPAN_MS = 20_000
Z_SCORE_LIMIT = 8.0

# --- windows and intervals -------------------------------------------------
RESULT_WINDOW = "1 second"
PROTOTYPE_WINDOW = "5 seconds"
PUBLISH_INTERVAL = "500 milliseconds"
SWEEP_INTERVAL = "10 seconds"

# --- code labels -----------------------------------------------------------
KEY_PREFIX = {1: "sql", 2: "sqlrep", 3: "spanner"}
TYPE_LABEL = {1: "cloud-sql", 2: "cloud-sql-read-replica", 3: "spanner"}
SIZE_LABEL = {1: "1x", 2: "2x", 3: "4x"}
SIZE_IN_NAME = {1: "sm", 2: "med", 3: "lrg"}
STATUSES = ["ready", "leased", "cleaning", "down"]

# --- load patterns: (seconds, transactions per second) segments ------------
LOAD_PATTERNS = {
    1: [(30, 10)],
    2: [(30, 50)],
    3: [(2, 60), (8, 10), (2, 60), (8, 10), (2, 60), (8, 10)],
}

# --- parallel load pods per intensity; other values stand for themselves ---
PODS_PER_INTENSITY = {2: 6, 3: 12}

# --- intended shares of the write mix --------------------------------------
INTENDED_MIX = {"insert": 0.7, "color": 0.1, "shape": 0.1, "artist": 0.1}

# --- dimension rows of the workload ----------------------------------------
COLORS = [
    (1, "red", "#FF0000"),
    (2, "orange", "#FFA500"),
    (3, "yellow", "#FFFF00"),
    (4, "green", "#00FF00"),
    (5, "blue", "#0000FF"),
    (6, "purple", "#9400D3"),
]

SHAPES = [
    (1, "square", 4),
    (2, "rectangle", 4),
    (3, "trapezoid", 4),
    (4, "triangle", 3),
    (5, "pentagon", 5),
    (6, "hexagon", 6),
    (7, "octagon", 8),
    (8, "circle", None),
    (9, "oval", None),
    (10, "square", 4),
    (11, "nonagon", 9),
    (12, "heptagon", 7),
    (13, "decagon", 10),
]

ARTISTS = [
    (1, "Bob", 46),
    (2, "Mary", 40),
    (3, "Jamie", 19),
    (4, "Jerome", 81),
    (5, "Sheila", 35),
    (6, "Mazie", 26),
    (7, "Zaydan", 52),
    (8, "Stephan", 14),
    (9, "Caio", 65),
    (10, "Sada", 21),
    (11, "Shanna", 62),
    (12, "Mohammod", 31),
    (13, "Cordelia", 22),
    (14, "Poppie", 75),
    (15, "Asad", 52),
    (16, "Gemma", 31),
    (17, "Jimmy", 66),
    (18, "Anushka", 42),
    (19, "Larissa", 18),
    (20, "Ruben", 39),
    (21, "Karson", 22),
    (22, "Yasmin", 71),
]
