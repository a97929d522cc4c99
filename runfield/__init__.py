"""Connected-component labelling and analysis of binary grids as Spark DataFrame plans."""
