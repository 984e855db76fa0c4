"""DataFrame -> DataFrame operators.

scan           skew-safe ordered scan (running counts/sums/previous value)
windows        character-budget windows and example rows (W1-W4, A2-A5)
conversations  donor split, conversation sizes and arrays (P2, P4, A1)
quality        noise filter, emoji count, dedups (P5, H3, W5, W6, A6)
splits         row numbers, dev/test cut, label ids, oversampling (W7, W9, F2-F5, A7)
metrics        F1 variants, matrices, ROC AUC, quantiles, BLEU (A8-A16, A18, A21)
intervals      subsample confidence intervals (A17)
align          prediction/truth pairing and label lookups (J2-J7)
"""
