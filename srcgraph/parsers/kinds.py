"""The names that trees can have: each language's kinds of named nodes, and the fields that nodes fill in their parents.

A query that asks for any other name is invalid. Tests hold the parsers to these tables.
"""

from __future__ import annotations

# Fixed values, by language.
NODES: dict[str, frozenset[str]] = {
    language: frozenset(names.split())
    for language, names in {
        "bash": """
        ansi_c_string arithmetic_expansion array binary_expression c_style_for_statement case_item case_statement command command_name
        command_substitution comment compound_statement concatenation declaration_command do_group elif_clause else_clause expansion extglob_pattern
        file_descriptor file_redirect for_statement function_definition heredoc_body heredoc_end heredoc_redirect heredoc_start herestring_redirect
        if_statement list negated_command number parenthesized_expression pipeline process_substitution program raw_string redirected_statement regex
        simple_expansion special_variable_name string string_content subscript subshell test_command test_operator unary_expression
        variable_assignment variable_assignments variable_name while_statement word
        """,
        "csharp": """
        accessor_declaration accessor_list anonymous_method_expression anonymous_object_creation_expression argument argument_list
        array_creation_expression array_rank_specifier array_type arrow_expression_clause as_expression assignment_expression attribute
        attribute_argument_list attribute_list attribute_target_specifier await_expression base_list binary_expression block boolean_literal
        bracketed_argument_list bracketed_parameter_list break_statement cast_expression catch_clause catch_declaration catch_filter_clause
        character_literal checked_expression class_declaration collection_expression comment compilation_unit conditional_access_expression
        conditional_expression constant_pattern constructor_declaration constructor_initializer continue_statement conversion_operator_declaration
        declaration_expression declaration_list declaration_pattern default_expression delegate_declaration destructor_declaration discard
        do_statement element_access_expression element_binding_expression empty_statement enum_declaration enum_member_declaration
        enum_member_declaration_list event_declaration event_field_declaration expression_statement field_declaration
        file_scoped_namespace_declaration finally_clause for_statement foreach_statement generic_name goto_statement identifier if_statement
        implicit_array_creation_expression implicit_object_creation_expression implicit_parameter implicit_type indexer_declaration
        initializer_expression integer_literal interface_declaration interpolated_string_expression interpolation invocation_expression
        is_pattern_expression labeled_statement lambda_expression local_declaration_statement local_function_statement lock_statement
        member_access_expression member_binding_expression method_declaration modifier namespace_declaration negated_pattern null_literal
        nullable_type object_creation_expression operator_declaration parameter parameter_list parenthesized_expression
        parenthesized_variable_designation pointer_type postfix_unary_expression predefined_type prefix_unary_expression property_declaration
        qualified_name raw_string_literal real_literal record_declaration recursive_pattern ref_type relational_pattern return_statement
        sizeof_expression string_literal struct_declaration switch_body switch_expression switch_expression_arm switch_expression_body switch_section
        switch_statement throw_expression throw_statement try_statement tuple_element tuple_expression tuple_type type_argument_list
        type_parameter_constraints_clause type_parameter_list typeof_expression unchecked_expression using_directive using_statement
        variable_declaration variable_declarator verbatim_string_literal when_clause while_statement with_body with_expression yield_statement
        """,
        "go": """
        argument_list array_type assignment_statement binary_expression blank_identifier block break_statement call_expression channel_type comment
        communication_case composite_literal const_declaration const_spec continue_statement dec_statement default_case defer_statement dot
        expression_case expression_list expression_statement expression_switch_statement fallthrough_statement false field_declaration
        field_declaration_list field_identifier float_literal for_clause for_statement func_literal function_declaration function_type generic_type
        go_statement goto_statement identifier if_statement imaginary_literal import_declaration import_spec import_spec_list inc_statement
        index_expression int_literal interface_type interpreted_string_literal iota keyed_element label_name labeled_statement literal_element
        literal_value map_type method_declaration method_elem nil package_clause package_identifier parameter_declaration parameter_list
        parenthesized_expression parenthesized_type pointer_type qualified_type range_clause raw_string_literal return_statement rune_literal
        select_statement selector_expression send_statement short_var_declaration slice_expression slice_type source_file struct_type true type_alias
        type_arguments type_assertion_expression type_case type_declaration type_elem type_identifier type_parameter_list type_spec
        type_switch_statement unary_expression var_declaration var_spec variadic_argument variadic_parameter_declaration
        """,
        "java": """
        annotation annotation_argument_list annotation_type_body annotation_type_declaration argument_list array_access array_creation_expression
        array_initializer array_type assert_statement assignment_expression asterisk binary_expression binary_integer_literal block block_comment
        boolean_type break_statement cast_expression catch_clause catch_formal_parameter catch_type character_literal class_body class_declaration
        class_literal compact_constructor_declaration constructor_body constructor_declaration continue_statement decimal_floating_point_literal
        decimal_integer_literal dimensions dimensions_expr do_statement element_value_array_initializer element_value_pair enhanced_for_statement
        enum_body enum_constant enum_declaration explicit_constructor_invocation expression_statement extends_interfaces false field_access
        field_declaration finally_clause floating_point_type for_statement formal_parameter formal_parameters generic_type hex_integer_literal
        identifier if_statement import_declaration inferred_parameters instanceof_expression integral_type interface_body interface_declaration
        labeled_statement lambda_expression line_comment local_variable_declaration marker_annotation method_declaration method_invocation
        method_reference modifiers null_literal object_creation_expression package_declaration parenthesized_expression permits program
        receiver_parameter record_declaration resource resource_specification return_statement scoped_identifier scoped_type_identifier
        spread_parameter static_initializer string_literal super super_interfaces superclass switch_block switch_block_statement_group
        switch_expression switch_label switch_rule synchronized_statement ternary_expression this throw_statement throws true try_statement
        try_with_resources_statement type_arguments type_identifier type_parameters type_pattern unary_expression update_expression
        variable_declarator void_type while_statement wildcard yield_statement
        """,
        "javascript": """
        arguments array array_pattern arrow_function assignment_expression assignment_pattern augmented_assignment_expression await_expression
        binary_expression break_statement call_expression catch_clause class class_body class_declaration class_heritage class_static_block comment
        computed_property_name continue_statement debugger_statement decorator do_statement else_clause empty_statement export_clause export_specifier
        export_statement expression_statement false field_definition finally_clause for_in_statement for_statement formal_parameters
        function_declaration function_expression generator_function generator_function_declaration hash_bang_line identifier if_statement import
        import_clause import_specifier import_statement jsx_element jsx_expression labeled_statement lexical_declaration member_expression
        meta_property method_definition method_signature named_imports namespace_export namespace_import nested_identifier new_expression null number
        object object_assignment_pattern object_pattern optional_chain pair pair_pattern parenthesized_expression private_property_identifier program
        property_identifier regex regex_flags regex_pattern rest_pattern return_statement sequence_expression shorthand_property_identifier
        shorthand_property_identifier_pattern spread_element statement_block statement_identifier string string_fragment subscript_expression super
        switch_body switch_case switch_default switch_statement template_string template_substitution ternary_expression this throw_statement true
        try_statement unary_expression undefined update_expression variable_declaration variable_declarator while_statement yield_expression
        """,
        "python": """
        aliased_import argument_list as_pattern as_pattern_target assert_statement assignment attribute augmented_assignment await binary_operator
        block boolean_operator break_statement call case_clause case_pattern class_definition comment comparison_operator concatenated_string
        conditional_expression continue_statement decorated_definition decorator default_parameter delete_statement dictionary
        dictionary_comprehension dictionary_splat dictionary_splat_pattern dotted_name elif_clause ellipsis else_clause except_clause
        except_group_clause exec_statement expression_list expression_statement false finally_clause float for_in_clause for_statement
        function_definition future_import_statement generator_expression global_statement identifier if_clause if_statement import_from_statement
        import_prefix import_statement integer interpolation keyword_argument keyword_separator lambda lambda_parameters list list_comprehension
        list_splat list_splat_pattern match_statement module named_expression none nonlocal_statement not_operator pair parameters
        parenthesized_expression pass_statement pattern_list positional_separator print_statement raise_statement relative_import return_statement set
        set_comprehension slice splat_pattern string string_content string_end string_start subscript true try_statement tuple type
        type_alias_statement type_parameter typed_default_parameter typed_parameter unary_operator while_statement wildcard_import with_clause
        with_item with_statement yield
        """,
        "rust": """
        abstract_type argument_list arguments array_expression array_type assignment_expression associated_type async_block attribute_item
        await_expression base_field_initializer binary_expression block block_comment boolean_literal bounded_type break_expression call_expression
        captured_pattern char_literal closure_expression closure_parameters compound_assignment_expr const_block const_item continue_expression crate
        declaration_list dynamic_type else_clause empty_statement enum_item enum_variant enum_variant_list expression_statement
        extern_crate_declaration field_declaration field_declaration_list field_expression field_identifier field_initializer field_initializer_list
        field_pattern float_literal for_expression foreign_mod_item function_item function_modifiers function_signature_item function_type
        generic_function generic_type higher_ranked_trait_bound identifier if_expression impl_item index_expression inner_attribute_item
        integer_literal label let_chain let_condition let_declaration lifetime line_comment loop_expression macro_definition macro_invocation
        match_arm match_block match_expression match_pattern mod_item mut_pattern mutable_specifier negative_literal never_type or_pattern
        ordered_field_declaration_list parameter parameters parenthesized_expression pointer_type primitive_type qualified_type_path range_expression
        range_pattern raw_string_literal ref_pattern reference_expression reference_pattern reference_type remaining_field_pattern removed_trait_bound
        return_expression scoped_identifier scoped_type_identifier scoped_use_list self self_parameter shorthand_field_identifier
        shorthand_field_initializer slice_pattern source_file static_item string_literal struct_expression struct_item struct_pattern super token_tree
        trait_bounds trait_item try_block try_expression tuple_expression tuple_pattern tuple_struct_pattern tuple_type type_arguments type_binding
        type_cast_expression type_identifier type_item type_parameters unary_expression union_item unit_expression unit_type unsafe_block
        use_as_clause use_declaration use_list use_wildcard visibility_modifier where_clause where_predicate while_expression yield_expression
        """,
        "typescript": """
        abstract_class_declaration abstract_method_signature accessibility_modifier ambient_declaration arguments array array_pattern array_type
        arrow_function as_expression asserts assignment_expression assignment_pattern augmented_assignment_expression await_expression
        binary_expression break_statement call_expression call_signature catch_clause class class_body class_declaration class_heritage
        class_static_block comment computed_property_name conditional_type constraint construct_signature constructor_type continue_statement
        debugger_statement decorator default_type do_statement else_clause empty_statement enum_assignment enum_body enum_declaration export_clause
        export_specifier export_statement expression_statement extends_clause extends_type_clause false finally_clause for_in_statement for_statement
        formal_parameters function_declaration function_expression function_signature function_type generator_function generator_function_declaration
        generic_type hash_bang_line identifier if_statement implements_clause import import_alias import_clause import_specifier import_statement
        index_signature index_type_query infer_type interface_body interface_declaration internal_module intersection_type jsx_element jsx_expression
        labeled_statement lexical_declaration literal_type lookup_type mapped_type_clause member_expression meta_property method_definition
        method_signature module named_imports namespace_export namespace_import nested_identifier nested_type_identifier new_expression
        non_null_expression null number object object_assignment_pattern object_pattern object_type optional_chain optional_parameter optional_type
        override_modifier pair pair_pattern parenthesized_expression parenthesized_type predefined_type private_property_identifier program
        property_identifier property_signature public_field_definition readonly_type regex regex_flags regex_pattern required_parameter rest_pattern
        rest_type return_statement satisfies_expression sequence_expression shorthand_property_identifier shorthand_property_identifier_pattern
        spread_element statement_block statement_identifier string string_fragment subscript_expression super switch_body switch_case switch_default
        switch_statement template_literal_type template_string template_substitution ternary_expression this this_type throw_statement true
        try_statement tuple_type type_alias_declaration type_annotation type_arguments type_assertion type_identifier type_parameter type_parameters
        type_predicate type_query unary_expression undefined union_type update_expression variable_declaration variable_declarator while_statement
        yield_expression
        """,
        "yaml": """
        alias anchor block_mapping block_mapping_pair block_node block_scalar block_sequence block_sequence_entry boolean_scalar comment document
        double_quote_scalar float_scalar flow_mapping flow_node flow_pair flow_sequence integer_scalar null_scalar plain_scalar reserved_directive
        single_quote_scalar stream string_scalar tag
        """,
    }.items()
}
FIELDS: dict[str, frozenset[str]] = {
    language: frozenset(names.split())
    for language, names in {
        "bash": """
        argument body condition descriptor destination index left name operator redirect right termination value variable
        """,
        "csharp": """
        accessors alternative argument arguments body condition consequence expression function initializer left name operand operator parameters
        pattern qualifier rank returns right subscript type type_parameters update value
        """,
        "go": """
        alias alternative arguments body channel communication condition consequence element field function initializer key label left length name
        operand operator package parameters path receiver result right tag type type_arguments type_parameters update value
        """,
        "java": """
        alternative argument arguments array body condition consequence constructor declarator dimensions element field index init key left name
        object operand operator parameters resources right scope type type_arguments type_parameters update value
        """,
        "javascript": """
        alias alternative argument arguments body condition consequence constructor declaration decorator finalizer function handler increment index
        initializer key kind label left name object operand operator optional_chain parameter parameters pattern property right source value
        """,
        "python": """
        alias alternative argument arguments attribute body cause condition consequence definition expression function guard key left module_name name
        object operator operators parameters return_type right subject subscript superclasses type type_parameters value
        """,
        "rust": """
        alias alternative argument arguments body bounds condition consequence element field function left length list macro name operand operator
        parameters path pattern return_type right trait type type_arguments type_parameters value
        """,
        "typescript": """
        alias alternative argument arguments body condition consequence constraint constructor declaration decorator finalizer function handler
        increment index initializer key kind label left module name object operand operator optional_chain parameter parameters pattern property
        return_type right source type type_arguments type_parameters value
        """,
        "yaml": """
        key value
        """,
    }.items()
}
