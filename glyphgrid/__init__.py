"""Text and geometry alignment of OCR pages, expressed as Spark DataFrame operators."""
