"""DataFrame -> DataFrame steps.

None of them collects rows, and none depends on how many rows share a key: lookups are
broadcast only after their size was measured, hot groups are reduced before they are
shuffled or split into bounded blocks.
"""
