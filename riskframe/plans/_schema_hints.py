"""Generated by tools/gen_schema_hints.py: (double columns, bigint columns)."""

HINTS = {'audit_events': ([], []),
 'audit_history': ([], ['event_id']),
 'best_by_auc': (['roc_auc'], []),
 'boxplot_stats': (['q1', 'median', 'q3', 'iqr', 'whisker_low', 'whisker_high'],
                   ['label', 'n', 'outliers']),
 'case_records': (['Malignant_Probability', 'Threshold'], []),
 'case_timeline': ([], []),
 'choose_candidate': (['selected_threshold', 'fbeta', 'recall', 'precision', 'f1'], []),
 'class_counts': ([], ['count']),
 'class_counts_segment': ([], ['count']),
 'class_weights': (['weight'], ['label', 'n_c']),
 'clean_target': ([], ['target', 'records']),
 'compare_tables': (['value_a', 'value_b'], []),
 'completeness': ([], ['vec_id', 'filled']),
 'confusion_metrics': (['accuracy',
                        'precision',
                        'recall',
                        'f1',
                        'specificity',
                        'false_negative_rate'],
                       ['tn', 'fp', 'fn', 'tp']),
 'correlation_matrix': (['correlation'], []),
 'cv_summary': (['accuracy_mean',
                 'accuracy_std',
                 'precision_mean',
                 'precision_std',
                 'recall_mean',
                 'recall_std',
                 'f1_mean',
                 'f1_std'],
                []),
 'decode_label': ([], ['records']),
 'describe_features': (['mean', 'std', 'min', 'p25', 'p50', 'p75', 'max'], ['count']),
 'display_fields': (['bar_pct'], []),
 'duplicate_rows': ([], ['duplicate_rows']),
 'duplicate_rows_lineitem': ([], ['duplicate_rows']),
 'factor_bars': (['bar_pct'], []),
 'fbeta': (['threshold', 'precision', 'recall', 'f2', 'f0_5'], []),
 'feature_labels': ([], ['p_partkey']),
 'feedback_agreement': (['Malignant_Probability'], []),
 'feedback_rejects': ([], []),
 'first_row': (['score'], ['label']),
 'global_importance': (['mean_abs_shap'], []),
 'kde': (['x', 'density'], ['label', 'grid_index']),
 'kfold_ordered': ([], ['o_orderkey', 'label', 'fold']),
 'knn_classify': (['probability'], ['vec_id', 'predicted']),
 'latest_prediction': (['value'], ['user_id', 'event_id']),
 'local_prediction': (['malignant_probability'], []),
 'metrics_by_model': (['accuracy',
                       'precision',
                       'recall',
                       'f1',
                       'specificity',
                       'false_negative_rate'],
                      ['tn', 'fp', 'fn', 'tp']),
 'missing_cells': ([], ['missing']),
 'permutation_shap': (['value', 'shap_value'], []),
 'quality_report': ([], ['value']),
 'rank_models': (['recall', 'roc_auc', 'f1'], ['fn', 'rank']),
 'rank_models_recall_auc': (['recall', 'roc_auc', 'f1'], ['rank']),
 'recommend_threshold': (['threshold',
                          'accuracy',
                          'precision',
                          'recall',
                          'f1',
                          'specificity',
                          'false_negative_rate',
                          'roc_auc'],
                         ['tn', 'fp', 'fn', 'tp']),
 'recommend_threshold_by_model': (['threshold',
                                   'accuracy',
                                   'precision',
                                   'recall',
                                   'f1',
                                   'specificity',
                                   'false_negative_rate',
                                   'roc_auc'],
                                  ['tn', 'fp', 'fn', 'tp']),
 'report_text': ([], []),
 'csv_rejects': ([], ['line_no']),
 'csv_valid': (['value'], ['line_no', 'n_features', 'pos']),
 'request_rejects': ([], ['vec_id']),
 'request_valid': ([], ['vec_id', 'n_features']),
 'response_json': ([], []),
 'risk_bands': ([], ['cases']),
 'roc_auc': (['roc_auc'], []),
 'roc_auc_by_model': (['roc_auc'], []),
 'roc_curve': (['threshold', 'fpr', 'tpr'], []),
 'roc_curve_all_points': (['threshold', 'fpr', 'tpr'], []),
 'sample_n': (['score'], ['label']),
 'score_cases': (['probability', 'probability_pct', 'threshold'], []),
 'select_threshold_f2': (['selected_threshold', 'fbeta', 'recall', 'precision', 'f1'], []),
 'shape': ([], ['rows', 'columns']),
 'shuffle_rank': ([], ['shuffle_rank']),
 'split_overlap': (['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], []),
 'split_report': ([], ['records', 'positives', 'negatives']),
 'standardise': (['l_quantity_z', 'l_extendedprice_z', 'l_discount_z', 'l_tax_z'], []),
 'stratified_holdout': ([], ['label']),
 'stratified_kfold': ([], ['label', 'fold']),
 'target_correlations': (['correlation_with_target'], []),
 'threshold_sweep_01': (['threshold',
                         'accuracy',
                         'precision',
                         'recall',
                         'f1',
                         'specificity',
                         'false_negative_rate',
                         'roc_auc'],
                        ['tn', 'fp', 'fn', 'tp']),
 'threshold_sweep_05': (['threshold',
                         'accuracy',
                         'precision',
                         'recall',
                         'f1',
                         'specificity',
                         'false_negative_rate',
                         'roc_auc'],
                        ['tn', 'fp', 'fn', 'tp']),
 'threshold_sweep_by_model': (['threshold',
                               'accuracy',
                               'precision',
                               'recall',
                               'f1',
                               'specificity',
                               'false_negative_rate',
                               'roc_auc'],
                              ['tn', 'fp', 'fn', 'tp']),
 'score_published_model': (['threshold'], []),
 'forest_factors': ([], ['n_factors']),
 'top_factors': (['value', 'shap_value'], ['rank']),
 'top_k': (['p_retailprice'], ['p_partkey']),
 'train_validation_test': ([], ['label']),
 'union_tables': (['score'], ['label']),
 'unpivot_features': (['value'], ['label'])}
