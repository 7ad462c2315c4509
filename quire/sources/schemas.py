"""Explicit schemas: nothing is inferred, so null columns and numbers keep their types."""

SPANS = "array<struct<start:int,end:int,type:string,raw:string,canonical_value:string,preserve_leading_zero:boolean>>"
SAMPLES = (
    "sample_id string, split string, image_path string, sha256 string, source_document_id string, writer_id string, reference_raw string, description string, "
    f"primary_stratum string, attributes array<string>, origin string, generation_method string, numeric_spans {SPANS}, is_blank boolean, annotator_status string, adjudicated boolean"
)
ROBUSTNESS = "sample_id string, parent_sample_id string, corruption string, severity int, seed bigint, parameters map<string,double>"
PREDICTIONS = (
    "run_id string, model_id string, model_revision string, adapter_version string, sample_id string, raw_prediction string, runtime_ms bigint, peak_vram_mb bigint, "
    "input_width int, input_height int, status string, retry_count int, prompt_hash string, config_hash string"
)
CANDIDATES = "rank int, id string, name string, category string, parameter_count_b double, persian_accuracy_estimation double, notes string"
REGISTRY = (
    "id string, display_name string, track string, runner string, repository string, revision string, availability string, requires_api_key boolean, input_mode string, "
    "prompt_id string, max_new_tokens int, temperature double, dtype string, device string, adapter_version string"
)
RUN_METADATA = "model_id string, model_revision string, input_path string, gpu string, torch string, python string, prompt string, generation struct<temperature:double,max_new_tokens:int>"

# Vocabularies.
STRATA = ["clean_modern_printed", "real_scanned_documents", "mobile_camera_photographs", "persian_handwriting", "numeric_heavy", "mixed_persian_english", "historical_or_naturally_degraded", "blank_non_text"]
SPLITS = ["smoke", "dev", "test"]
CORRUPTIONS = ["gaussian_blur", "motion_blur", "jpeg_compression", "downsampling", "noise", "rotation_skew", "shadow_contrast"]
STATUSES = ["QUALIFIED", "BORDERLINE", "FAILED_PERSIAN_SUPPORT", "NOT_APPLICABLE", "UNAVAILABLE"]
TRACKS = ["general_line_recognition", "handwriting_specialist", "digit_specialist", "pipeline", "not_ocr", "unavailable"]
#: Samples of each stratum in (dev, test).
QUOTAS = {
    "clean_modern_printed": (12, 148),
    "real_scanned_documents": (7, 83),
    "mobile_camera_photographs": (5, 55),
    "persian_handwriting": (9, 111),
    "mixed_persian_english": (5, 55),
    "numeric_heavy": (6, 74),
    "historical_or_naturally_degraded": (4, 55),
    "blank_non_text": (1, 19),
}
SPLIT_SIZES = {"smoke": 20, "dev": 49, "test": 600}
#: Weights of the strata in domain-balanced scores.
STRATUM_WEIGHTS = {
    "clean_modern_printed": 0.20,
    "real_scanned_documents": 0.15,
    "mobile_camera_photographs": 0.10,
    "persian_handwriting": 0.20,
    "mixed_persian_english": 0.10,
    "numeric_heavy": 0.15,
    "historical_or_naturally_degraded": 0.10,
}
#: Weights of the ten metrics in the composite.
METRIC_WEIGHTS = {
    "canonical_cer": 0.25,
    "strict_cer": 0.10,
    "canonical_wer": 0.10,
    "chrfpp": 0.08,
    "exact_line": 0.07,
    "spacing_f1": 0.10,
    "numeric_span": 0.10,
    "omission": 0.07,
    "hallucination": 0.07,
    "robustness": 0.06,
}
#: The metrics that are scored within strata first.
BALANCED = ["canonical_cer", "strict_cer", "canonical_wer", "chrfpp", "exact_line", "omission", "hallucination"]
#: Anchors of the robustness set by type.
ANCHORS = {"modern_print": 14, "handwriting": 6, "numeric_heavy": 4, "mixed_persian_english": 3, "form_like": 3}
#: Least numbers of secondary attributes.
ATTRIBUTE_MINIMA = {
    "source_documents": 200, "writers": 30, "zwnj_lines": 180, "zwnj_boundaries": 300, "numeric_spans": 300, "dates_times": 60, "prices": 60, "percentages": 40,
    "identifiers": 80, "persian_digit_spans": 150, "latin_digit_spans": 60, "arabic_digit_spans": 20, "mixed_lines": 60, "blank_crops": 20, "font_families": 15,
}
