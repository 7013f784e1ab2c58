"""Column functions: text, addresses, time, money, scores, classification."""
