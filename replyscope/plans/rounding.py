"""Rounding of double outputs for the engine-to-engine comparison."""

# Output columns of type DOUBLE per query, rounded to ROUND_DIGITS places on both sides (Spark and SQL) so
# summation order cannot change a compared value. tests/test_plans.py keeps this in sync with the schemas.
ROUND_DIGITS = 9
DOUBLE_COLUMNS = {
    'accuracy_all': ('accuracy',),
    'accuracy_choice': ('accuracy',),
    'accuracy_options': ('accuracy',),
    'accuracy_ratings': ('accuracy',),
    'accuracy_yesno': ('accuracy',),
    'annotation_gap': ('gap_seconds',),
    'char_bleu': ('bleu',),
    'chat_gold': ('temperature',),
    'chat_gold_true': ('temperature',),
    'chat_guess': ('temperature',),
    'chat_history': ('temperature',),
    'chat_history_native': ('temperature',),
    'chat_native': ('temperature',),
    'chat_non_native': ('temperature',),
    'chat_standard': ('temperature',),
    'chat_trial': ('temperature',),
    'comparison_pivot': ('model_a_standard_native', 'model_a_standard_non_native', 'model_a_native_native', 'model_a_native_non_native', 'model_a_non_native_native', 'model_a_non_native_non_native', 'model_a_guess_native_native', 'model_a_guess_native_non_native', 'model_a_guess_native_correct_native', 'model_a_guess_native_correct_non_native'),
    'comparison_pivot_dataset': ('model_a_standard_native', 'model_a_standard_non_native', 'model_a_native_native', 'model_a_native_non_native', 'model_a_non_native_native', 'model_a_non_native_non_native', 'model_a_guess_native_native', 'model_a_guess_native_non_native', 'model_a_guess_native_correct_native', 'model_a_guess_native_correct_non_native'),
    'decoding_parameters': ('temperature', 'top_p', 'judge_temperature', 'judge_top_p'),
    'gold_two_stage': ('temperature',),
    'guess_two_stage': ('temperature',),
    'group_covariance': ('cov',),
    'greedy_match_score': ('precision', 'recall', 'f1'),
    'loglik_score': ('faithful', 'precision', 'recall', 'f1'),
    'macro_accuracy_dataset': ('accuracy',),
    'macro_accuracy_overall': ('accuracy',),
    'macro_accuracy_set': ('accuracy',),
    'macro_accuracy_sets': ('accuracy',),
    'mean_gap_by_group': ('mean_gap_seconds',),
    'multi_ref_score': ('mean_score', 'max_score'),
    'no3': ('accuracy',),
    'pca_2d': ('pc1', 'pc2'),
    'projected_points': ('pc1', 'pc2'),
    'report_csv': ('accuracy',),
    'rouge1': ('rouge_1',),
    'rouge2': ('rouge_2',),
    'rouge_l': ('rouge_l',),
    'rouge_lsum': ('rouge_lsum',),
    'run_comparison': ('accuracy', 'bleu', 'rouge_1', 'rouge_2', 'rouge_l', 'bertscore_precision', 'bertscore_recall', 'bertscore_f1', 'bartscore_faithful', 'bartscore_precision', 'bartscore_recall', 'bartscore_f1'),
    'run_comparison_all': ('accuracy', 'bleu', 'rouge_1', 'rouge_2', 'rouge_l', 'rouge_lsum', 'bertscore_precision', 'bertscore_recall', 'bertscore_f1', 'bartscore_faithful', 'bartscore_precision', 'bartscore_recall', 'bartscore_f1'),
    'scores_all': ('accuracy', 'bleu', 'rouge_1', 'rouge_2', 'rouge_l', 'bertscore_precision', 'bertscore_recall', 'bertscore_f1', 'bartscore_faithful', 'bartscore_precision', 'bartscore_recall', 'bartscore_f1'),
    'scores_selected': ('accuracy',),
    'filled_accuracy': ('accuracy',),
    'standardize_vectors': ('value',),
    'temperature': ('temperature',),
    'total_time_by_group': ('mean_total_seconds',),
    'wide_scores_roundtrip': ('accuracy',),
    'word_count_by_group': ('avg_words_prompt', 'avg_words_reply'),
}
