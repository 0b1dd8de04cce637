"""cohortframe: genotype / phenotype analytics as PySpark DataFrame jobs.

Tables are long: ``geno(sample_id, var_id, dosage)``, ``pheno(sample_id, y)``,
``variants(var_id, chr, pos, ref, alt)``.  Every operator takes DataFrames and
returns a DataFrame; nothing is collected to the driver except values whose
size is fixed by the call (a scalar, a k x k matrix, a list of column names).
"""

__version__ = "0.1.0"
