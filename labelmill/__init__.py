"""Label the rows of a Spark table with a language model: requests out, typed answers and row errors back."""

from labelmill.errors import LabelError, SpecError
from labelmill.plans.labeler import Labeled, Labeler
from labelmill.spec import LabelSpec, OutputField, fields_from_class, fields_from_struct, spec_from_dict

__all__ = ["LabelError", "LabelSpec", "Labeled", "Labeler", "OutputField", "SpecError", "fields_from_class", "fields_from_struct", "spec_from_dict"]
