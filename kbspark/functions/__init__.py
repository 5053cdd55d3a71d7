"""Column expressions: text, scores, codes and the vector block kernel."""
