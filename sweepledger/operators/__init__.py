"""DataFrame-to-DataFrame operators.

Set comparisons are written as one union and one grouping on the compared key:
both sides are pre-aggregated before a single shuffle, so repeated rows and hot
keys collapse before they travel, and no side has to be small.
"""
