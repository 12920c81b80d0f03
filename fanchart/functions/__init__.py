"""Column expressions: dates, text, frames, quantiles and error metrics."""
