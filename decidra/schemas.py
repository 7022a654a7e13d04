"""Row types of the engine. Ordered keys are arrays of structs, never maps: an option's place has meaning."""

CRITERIA = "ARRAY<STRUCT<key: STRING, descr: STRING>>"
QUESTION = f"STRUCT<qid: STRING, qtype: STRING, instructions: STRING, criteria: {CRITERIA}>"
TARGET = "STRUCT<qid: STRING, hard: STRING, p_yes: DOUBLE, soft: ARRAY<STRUCT<key: STRING, p: DOUBLE>>>"
META = "STRUCT<id: STRING, source: STRING, site: STRING, step_id: STRING, candidate: STRING, which: STRING, track: STRING, goal_kind: STRING, url_before: STRING, url_after: STRING, text_before: STRING, text_after: STRING>"
ROW = f"id STRING, source STRING, split STRING, state STRING, images ARRAY<STRING>, questions ARRAY<{QUESTION}>, targets ARRAY<{TARGET}>, meta {META}"
ITEM = f"id STRING, track STRING, question STRING, type STRING, instructions STRING, criteria {CRITERIA}, state STRING, images ARRAY<STRING>, label STRING, site STRING, goal_kind STRING, step_id STRING, url_before STRING, url_after STRING, elements_before STRING, elements_after STRING, candidate STRING, which STRING"
PREDICTION = "id STRING, p DOUBLE, choice STRING, ms DOUBLE"
BOX = "STRUCT<tag: STRING, type: STRING, text: STRING, x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
STEP = (
    "id STRING, site STRING, goal STRING, goal_kind STRING, goal_value STRING, target_text STRING, target_href STRING, start_url STRING, step INT, "
    "history ARRAY<STRING>, policy STRING, action STRING, typed STRING, chosen STRING, target_idx STRING, before_img STRING, after_img STRING, "
    "raw_before_img STRING, raw_after_img STRING, before_url STRING, after_url STRING, candidates ARRAY<STRUCT<k: INT, text: STRING>>, "
    f"candidates_after ARRAY<STRUCT<k: INT, text: STRING>>, boxes_before ARRAY<{BOX}>, boxes_after ARRAY<{BOX}>, "
    "labels STRUCT<skip: ARRAY<STRUCT<k: INT, v: INT>>, effect: INT, done_before: INT, done_after: INT, noisy: INT>, "
    "signals STRUCT<url_changed: BOOLEAN, dom_changed: BOOLEAN, value_applied: BOOLEAN, pix_change: DOUBLE, pix_noise: DOUBLE, act_err: STRING>, error STRING"
)
TRAIN_LOG = "step LONG, loss DOUBLE, lr DOUBLE, elapsed DOUBLE, eval STRING"
