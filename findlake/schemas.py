"""Dimension values of the model: ordered enums, weights and policies."""

from __future__ import annotations

# The ladders, factors, policies and ceilings that scores are defined by.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
CATEGORIES = ("security", "secret", "dependencies", "correctness", "performance", "quality", "testing", "configuration", "metric")
#: Severity weights times 4, so that sums are whole.
SEVERITY_4 = {"critical": 40, "high": 24, "medium": 12, "low": 4, "info": 1}
#: Confidence factors of scores times 10, and of priorities times 20.
CONFIDENCE_10 = {"high": 10, "medium": 7, "low": 4}
CONFIDENCE_20 = {"high": 20, "medium": 11, "low": 5}
#: How actionable a category is, times 20.
LEVERAGE_20 = {"secret": 20, "security": 20, "dependencies": 17, "correctness": 15, "performance": 9, "configuration": 8, "testing": 7, "quality": 6, "metric": 2}
#: category: (weight times 2, sensitivity, penalty divided by the root of the number of files)
POLICIES = {
    "secret": (6, 0.60, False),
    "security": (6, 0.30, False),
    "dependencies": (4, 0.18, False),
    "correctness": (4, 0.12, True),
    "testing": (3, 0.35, False),
    "configuration": (2, 0.30, False),
    "performance": (2, 0.15, True),
    "quality": (2, 0.10, True),
    "metric": (0, 0.10, True),
}
CEILINGS = {"critical": 39, "high": 69}
CAPPING = ("security", "secret")
ACTIONABLE = ("secret", "security", "dependencies", "correctness")
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
#: Findings that a report keeps, and reports and runs that are compared with.
REPORT_LIMIT, HISTORY = 500, 10
