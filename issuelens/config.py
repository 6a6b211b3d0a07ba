"""Fixed values that must equal the reference's for identical results.

Kept together, in their natural order, as plain text.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly)
# ---------------------------------------------------------------------------

# Class names in argmax order (first maximum wins in this order).
CLASSES = ["simple", "moderate", "complex"]

# Label sets of the heuristic scorer (exact, lower-cased match).
PERF_LABELS = ["performance", "optimization", "latency"]
BUG_LABELS = ["bug", "regression"]
DOCS_LABELS = ["docs", "documentation"]
SECURITY_LABELS = ["security", "vulnerability", "cve"]
PERF_TITLE_TOKEN = "perf"

# Heuristic weights: 0.6 * min(1, chars/4000) + 0.4 * min(1, words/800)
# + 0.25 security + 0.15 perf + 0.10 bug - 0.10 docs, clamped to [0, 1].
# Used in the exact integer form (score scaled by 20000):
CHAR_CAP, CHAR_WEIGHT = 4000, 3
WORD_CAP, WORD_WEIGHT = 800, 10
SECURITY_POINTS, PERF_POINTS, BUG_POINTS, DOCS_POINTS = 5000, 3000, 2000, 2000
SCORE_SCALE = 20000

# Label derived from a comment count: <=1 simple(0), <=5 moderate(1), else complex(2).
SIMPLE_MAX_COMMENTS = 1
MODERATE_MAX_COMMENTS = 5

# Feature patterns, applied case-insensitively to the body.
CODE_PATTERN = r"```|`[^`]+`"
IMAGE_PATTERN = r"!\[.*\]|<img"
URL_PATTERN = r"http[s]?://"

# Numeric feature order of the stacked model.
NUMERIC_FEATURES = [
    "len_title", "len_body", "word_count", "has_code", "has_image", "has_url",
    "user_issue_count", "is_new_user", "labels_count", "reactions",
]
PROB_FEATURES = ["prob_simple", "prob_moderate", "prob_complex"]

# Webhook handling.
ISSUE_EVENT = "issues"
COMMENT_EVENT = "issue_comment"
ISSUE_ACTIONS = ["opened", "edited", "reopened"]
COMMENT_ACTION = "created"
COMPLEXITY_LABEL_PREFIX = "complexity:"
IGNORED_ISSUE_REASON = "Action not relevant for complexity prediction"
IGNORED_COMMENT_REASON = "Comment event not relevant for complexity prediction"
MISSING_SIGNATURE = "Missing signature"
INVALID_SIGNATURE = "Invalid signature"

# Routing: complexity -> team, with a default.
TEAM_ASSIGNMENTS = [
    ("simple", "junior-developers"),
    ("moderate", "mid-level-developers"),
    ("complex", "senior-developers"),
]
DEFAULT_TEAM = "unassigned"
COMPLEXITY_COLORS = [("simple", "#4CAF50"), ("moderate", "#FF9800"), ("complex", "#F44336")]
DEFAULT_COLOR = "#808080"
COMPLEXITY_EMOJI = [("simple", "\U0001F7E2"), ("moderate", "\U0001F7E1"), ("complex", "\U0001F534")]
DEFAULT_EMOJI = "⚪"
COMPLEX_MENTION = "<!channel> \U0001F6A8 New complex issue requires senior attention!"
ISSUE_URL_HOST = "https://github.com"
NOTIFY_TITLE_CHARS = 80
NOTIFY_HEADER = " New Issue Triaged"
NOTIFY_BUTTON = "\U0001F4CB View Issue"
NOTIFY_TIME = "\u23F0 Triaged at "

# Consolidation.
DEDUP_TITLE_CHARS = 128
SOURCE_BONUS = 1_000_000_000  # per source point; feedback has 2 points
LABEL_BONUS = 10_000_000
REPO_CANDIDATES = ["repo", "repository"]
NUMBER_CANDIDATES = ["issue_number", "number", "id"]
TARGET_CANDIDATES = ["human_label", "complexity", "complexity_label", "predicted_complexity", "label"]
CONSOLIDATED_COLUMNS = [
    "timestamp", "repo", "issue_number", "title", "body", "labels", "comments", "target_label", "source",
]

# Dashboard.
HIGH_CONFIDENCE = 0.9
HIGH_VOLUME_SHARE = 0.3
HEALTHY_SHARE = 0.1
ADVICE_HIGH = "High volume of complex issues. Consider allocating more Senior Engineers to triage."
ADVICE_HEALTHY = "Healthy mix. Junior/Mid-level devs should be able to handle the current load."
ADVICE_STANDARD = "Standard load. Maintain current team distribution."
TOP_LABELS = 10
HIGH_PRIORITY_ROWS = 10
RECENT_LIMIT = 100

# Remedy suggestion texts.
DESIGN_LABELS = ["feature", "enhancement", "design"]
ESCALATION_COMMENTS = 10
REMEDY_SIMPLE = ("Good first issue. Assign junior dev; ETA 1–2 days. "
                 "Add labels: ['complexity:simple', 'good first issue']. Confidence {pct}.")
REMEDY_MODERATE = ("Assign mid-level dev; ETA 2–5 days. {design}"
                   "Add labels: ['complexity:moderate', 'needs triage']. Confidence {pct}.")
REMEDY_DESIGN = "Schedule quick design review. "
REMEDY_COMPLEX = ("Assign senior dev; plan spike + breakdown into subtasks; ETA 1–2 weeks. "
                  "{escalation}Add labels: ['complexity:complex', 'needs investigation', 'priority:high']. "
                  "Confidence {pct}.")
REMEDY_ESCALATION = "High comments, consider escalation. "
REMEDY_OTHER = "Review needed; insufficient data. Confidence {pct}."

# Rows of an upload shown before scoring.
PREVIEW_ROWS = 5

# Advisor prompt (generation call itself is not built).
PROMPT_BODY_CHARS = 3000

# Collection.
MAX_ISSUES_PER_REPO = 1000
INCLUDE_CLOSED = True
MIN_COMMENTS = 0
MONITORED_REPOS = [
    "angular/angular", "apple/swift", "aws/aws-sdk-go", "elastic/elasticsearch", "envoyproxy/envoy",
    "expressjs/express", "facebook/react", "flutter/flutter", "golang/go", "grpc/grpc",
    "hashicorp/terraform", "hashicorp/vault", "helm/helm", "istio/istio", "kubernetes/helm",
    "kubernetes/kubernetes", "microsoft/TypeScript", "microsoft/vscode", "netty/netty", "nodejs/node",
    "numpy/numpy", "pandas-dev/pandas", "prometheus/prometheus", "pytorch/pytorch", "rails/rails",
    "redis/redis", "rust-lang/rust", "scikit-learn/scikit-learn", "spring-projects/spring-boot",
    "square/okhttp", "square/retrofit", "tensorflow/tensorflow",
]

# Learning.
RANDOM_STATE = 42
TEST_SIZE = 0.2
MIN_ISSUES_FOR_RETRAIN = 100
TEXT_NGRAM_MAX = 2
SMOTE_K = 5
GBT_TREES = 500
GBT_DEPTH = 4
GBT_STEP = 0.03
GBT_SUBSAMPLE = 0.8
GBT_COLSAMPLE = 0.8
GBT_EARLY_STOP = 50

# Advisor prompt template (fixed text; 8-space indentation and the in-template
# comment after the body are part of the prompt).
ADVISOR_PROMPT = (
    "\n"
    "        Act as a senior software engineer acting as a mentor. Analyze this GitHub issue strategy only.\n"
    "        \n"
    "        Issue Title: {title}\n"
    "        Labels: {labels}\n"
    "        \n"
    "        Issue Body:\n"
    "        {body}  # Truncate to avoid token limits if extremely long\n"
    "        \n"
    "        Provide a concise technical response in Markdown format:\n"
    "        \n"
    "        ### \U0001F50D Root Cause Analysis (Hypothetical)\n"
    "        [Brief analysis of what might be wrong]\n"
    "        \n"
    "        ### \U0001F6E0 Suggested Fix Steps\n"
    "        1. [Step 1]\n"
    "        2. [Step 2]\n"
    "        ...\n"
    "        \n"
    "        ### \U0001F4BB Code Hint\n"
    "        ```python\n"
    "        # Illustrative snippet (if applicable)\n"
    "        ```\n"
    "        \n"
    "        ### ⚠️ Risks\n"
    "        [Potential side effects or interactions]\n"
    "        "
)

# ---------------------------------------------------------------------------
# Fixture parameters for the views over /root/testdata (our own choices).
# ---------------------------------------------------------------------------
WEBHOOK_SECRET = "topsecret"
BAD_SIGNATURE = "sha256=deadbeef"
