"""Fixed workload values of the re-ranking pipeline.

FIXED VALUES (must equal the pipeline being re-expressed, do not tune):
  list length 10, negatives per list 9, history cap 30, per-category history
  cap 20, cloud lag 3, metric cutoffs 1 5 7, exposure scope 5,
  target exposure ratio 0.5 0.4 0.1, log-loss epsilon 1e-7,
  smoothed-KL epsilon 1e-9, gumbel epsilon 1e-10, min history length 0
  (strictly greater kept), min positives 1, min negatives 1,
  item fields: pos pagenum sex price_level age_level bc_type score,
  user fields: user_os user_gender user_age_level user_purchase_level user_hour,
  category field index 5 (bc_type), batch size 128, js lambda 0.5,
  relaxed top-k temperature 1.0.
"""

LIST_LEN = 10
CANDIDATE_NEG_NUM = 9
HIST_MAX_LEN = 30
HIST_CATE_MAX_LEN = 20
CLOUD_LAG = 3
METRIC_SCOPES = (1, 5, 7)
EXPOSURE_SCOPE = 5
TARGET_EXPOSURE = (0.5, 0.4, 0.1)
LOGLOSS_EPS = 1e-7
KL_EPS = 1e-9
GUMBEL_EPS = 1e-10
FILTER_HIST_NUM = 0
FILTER_POS_NUM = 1
FILTER_NEG_NUM = 1
BATCH_SIZE = 128
JS_LAMBDA = 0.5
GUMBEL_TAU = 1.0

ITEM_FIELDS = ("pos", "pagenum", "sex", "price_level", "age_level", "bc_type", "score")
HIST_FIELDS = ITEM_FIELDS[:6]
USER_FIELDS = ("user_os", "user_gender", "user_age_level", "user_purchase_level", "user_hour")
CATE_FIELD = "bc_type"
CATE_IDX = 5

# Hash seed for all deterministic sampling (md5 of seed and key).
DEFAULT_SEED = "42"
