"""Column functions: text, url, scores, keyword rules, model output."""
