"""Vocabularies, lookup tables, texts and thresholds.

Every operator takes them as defaults, so another vocabulary can be passed in.
"""

# Actions in declared order; listings keep this order.
ACTIONS = [
    "EAT", "DRINK", "PLAY", "FETCH", "SLEEP",
    "SOCIAL", "FOLLOW", "TOILET", "IDLE", "EXPLORE",
]
ALWAYS_AVAILABLE = ["TOILET", "IDLE", "EXPLORE"]
FALLBACK_ACTIONS = ["IDLE", "EXPLORE"]
DEFAULT_ACTION = "IDLE"

OBJECT_TYPES = ["bowl", "bed", "toy", "player", "pet"]

# Two tie orders: the labeller and the prompt text break equal stats differently.
LABEL_STATS = ["hunger", "tiredness", "boredom", "social", "toilet"]
PROMPT_STATS = ["hunger", "boredom", "social", "toilet", "tiredness"]

STAT_ACTIONS = {
    "hunger": ["EAT", "DRINK"],
    "tiredness": ["SLEEP"],
    "boredom": ["PLAY", "FETCH"],
    "social": ["SOCIAL", "FOLLOW"],
    "toilet": ["TOILET"],
}

# An empty list means that the stat needs no object.
STAT_TYPES = {
    "hunger": ["bowl"],
    "tiredness": ["bed"],
    "boredom": ["toy"],
    "social": ["player", "pet"],
    "toilet": [],
}

ACTION_TYPES = {
    "EAT": ["bowl"],
    "DRINK": ["bowl"],
    "PLAY": ["toy"],
    "FETCH": ["toy"],
    "SLEEP": ["bed"],
    "SOCIAL": ["player", "pet"],
    "FOLLOW": ["player", "pet"],
}

# Prompt text.
PROMPT_INTRO = "You are an AI pet brain. Choose the best action for the pet."
PROMPT_STATS_HEAD = "Stats (highest first): "
PROMPT_RULE = (
    "Rule: choose the action that satisfies the highest stat. "
    "If a target object is required, select the closest one."
)
PROMPT_GUIDE = (
    "Guide: hunger→EAT/DRINK(bowl) | tiredness→SLEEP(bed) | "
    "boredom→PLAY/FETCH(toy) | social→SOCIAL/FOLLOW(player,pet) | toilet→TOILET"
)
PROMPT_SCENE_HEAD = "Scene (nearest first): "
PROMPT_ACTIONS_HEAD = "Available actions: "
PROMPT_TAIL = "Respond with JSON only."
PROMPT_MARKER = "Stats"

# Thresholds.
NEED_THRESHOLD = 0.5
VALID_RATE_PASS = 0.95
STAT_ACCURACY_PASS = 0.90
TARGET_ACCURACY_PASS = 0.90
CONFLICT_ACCURACY_PASS = 0.80
FALLBACK_ACCURACY_PASS = 0.90
MAX_ACTION_SHARE = 0.30
MIN_CLASS_SHARE = 0.05
MAX_CLASS_SHARE = 0.25
MIN_BALANCE_ROWS = 50

# Dataset and training-table settings.
DATA_SEED = 42
PROBE_SEED = 999
CONFLICT_RATE = 0.15
OBJECT_PRESENT_RATE = 0.75
MAX_TICK = 10_000
MAX_LENGTH = 512
IGNORE_INDEX = -100
PATIENCE = 3
HEARTBEAT_SECONDS = 120
TRAIN_HEARTBEAT_SECONDS = 600

# Run registry.
RUN_STATUSES = [
    "pending", "generating", "training", "evaluating",
    "exporting", "running", "completed", "failed",
]
JOB_STATES = ["pending", "running", "done", "failed"]
TERMINAL_STATES = ["done", "failed"]
# Seconds without a beat after which a worker is lost, by stage.
STAGE_TIMEOUTS = {"training": 600}
OTHER_TIMEOUT = 120
STAGE_NAMES = ["Generate", "Train", "Evaluate", "Export"]
STAGE_OF_STATUS = {"generating": 0, "training": 1, "evaluating": 2, "exporting": 3}

# Provider states; None is a state that only a status file can settle.
POD_STATES = {
    "CREATED": "pending", "RUNNING": "running", "EXITED": None,
    "FAILED": "failed", "TERMINATED": "failed",
}
INSTANCE_STATES = {
    "created": "pending", "loading": "pending", "running": "running",
    "exited": None, "stopped": None,
}
# First keyword found in the text wins.
KEYWORD_STATES = [
    ("complete", "done"), ("error", "failed"), ("failed", "failed"),
    ("running", "running"), ("queued", "pending"), ("cancelacknowledged", "failed"),
]
BACKENDS = ["vastai", "runpod", "kaggle", "ssh", "colab"]
LOG_NOISE = ["remote port forwarding failed", "Permanently added"]

# Metric names in progress texts, by source.
NOTEBOOK_METRICS = ["loss", "eval_loss", "grad_norm"]
HOST_METRICS = ["loss", "eval_loss"]
