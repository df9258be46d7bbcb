"""Explicit schemas of the file formats; nothing is inferred."""

# --- fixed values: field names and layouts of the input files ---
SCENARIO = (
    "id:string,title:string,description:string,objective:string,empathy_pressure:string,rubric:map<string,string>"
)
POSITIVE_FIELDS = ["empathic_text", "empathetic", "empathic"]
NEGATIVE_FIELDS = ["non_empathic_text", "non_empathetic", "non_empathic"]
PAIR = (
    "scenario_id string, scenario_title string, "
    + ", ".join(f"{f} string" for f in POSITIVE_FIELDS + NEGATIVE_FIELDS)
    + ", source_model string, run_id int, generated_at string, format string"
)
LAYER_METRICS = (
    "layer:int,auroc:double,accuracy:double,empathic_mean:double,non_empathic_mean:double,"
    "separation:double,empathic_std:double,non_empathic_std:double"
)
VALIDATION = f"layer_results map<string,struct<{LAYER_METRICS}>>, best_layer int, best_auroc double"
MODEL_METRICS = (
    f"map<string,struct<model:string,model_key:string,hidden_size:int,layers:map<string,struct<{LAYER_METRICS}>>>>"
)
CONDITION = "struct<alpha:double,condition_name:string,samples:array<string>>"
EXPERIMENT = (
    "struct<layer:int,scenario:string,title:string,empathy_pressure:string,expected_change:string,"
    f"conditions:array<{CONDITION}>,baseline:string,baseline_samples:array<string>,"
    "steered_completions:array<struct<alpha:double,completion:string,samples:array<string>>>>"
)
RUN = (
    "struct<model:string,model_key:string,target_layer:int,layers_tested:array<int>,alphas_tested:array<double>,"
    f"layer_results:array<struct<layer:int,experiments:array<{EXPERIMENT}>>>,experiments:array<{EXPERIMENT}>>"
)
RATING = "scenario:string,true_score:int,probe_score:double,expected_category:string,text_preview:string"
SUMMARY_CSV = (
    "model string, layer int, scenario string, steering_success_rate double, baseline_empathy_rate double, "
    "num_alphas int"
)
DIRECTION = "model string, layer int, direction array<double>"
