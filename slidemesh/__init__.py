"""Analytics over tables of detected visual components, expressed as Spark DataFrame plans."""
