"""Persian text analytics as DataFrame operators."""
