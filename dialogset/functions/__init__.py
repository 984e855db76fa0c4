"""Column -> Column expression builders (JVM-side, no UDFs).

labels  n-hot label rules (A2-A5, H9-H15, H25, P6, J3)
text    joins, verbalisation, generated-string parsing, tokens (H1, H2, H16-H24)
scores  softmax, sigmoid, thresholds, argmax (H4-H8)
"""
