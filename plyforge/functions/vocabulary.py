"""The words that results, reasons and verdicts are written in."""

# Results of games; one that isn't resolved is "*".
RESULTS = ("1-0", "0-1", "1/2-1/2")
UNRESOLVED = "*"

# Why a game can't be paired, in the order in which the reasons are tried.
EXCLUSION_CODES = (
    "missing_white_or_black_header",
    "missing_result_header",
    "unresolved_or_invalid_result",
    "unrecognized_engine_labels",
    "missing_or_invalid_fen_for_opening_ref",
)

# States of a sequential test, and what a finished one says.
TEST_STATES = ("H0_ACCEPTED", "H1_ACCEPTED", "CAP_REACHED", "CONTINUE")
VERDICTS = ("SUPPORTED_PROGRESS", "PROGRESS_NOT_SUPPORTED", "INCONCLUSIVE")

# How the point estimates of a series move, and where an interval lies.
DIRECTIONS = ("INSUFFICIENT_POINTS", "NONDECREASING", "NONINCREASING", "FLAT", "MIXED")
INTERVAL_SIDES = ("ENTIRELY_ABOVE_ZERO", "ENTIRELY_BELOW_ZERO", "CROSSES_ZERO")

# Classes of a mined position.
POSITION_CLASSES = ("EVIDENCE_INCOMPLETE", "AGREEMENT", "MOVE_DISAGREEMENT", "TEACHER_OUTSIDE_CANDIDATE_TOPK")
